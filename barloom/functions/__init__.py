"""Column-level functions: indicators and the sequential helper."""
