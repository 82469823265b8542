"""Plans over logs: what a snapshot sees, what recovery decides, what can go. Each takes and gives DataFrames of any origin."""
