"""A PySpark engine for versioned document tables, kept as an append-only change log."""
