"""Index maintenance from a stream of changes."""
