"""Table-valued operators: parsers, layout, merging, retrieval, assignment."""
