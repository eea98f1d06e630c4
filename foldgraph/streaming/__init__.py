"""Continuous arrival of triples."""
