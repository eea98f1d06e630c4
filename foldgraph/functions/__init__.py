"""Column functions: RDF terms, IRIs, level intervals."""
