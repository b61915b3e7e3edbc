"""Search operators and vector indexes."""
