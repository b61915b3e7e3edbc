"""Vector values: construction, display, validation and distances."""
