"""Options, configuration files, versioned tables and the catalog of vector columns."""
