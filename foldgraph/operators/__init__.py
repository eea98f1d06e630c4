"""DataFrame operators on graphs, partitions and summaries."""
