"""What users call: the engine, its transactions, maintenance, backups, locks, and relational helpers."""
