"""DataFrame operators: index, routing, evidence, ingest and operations."""
