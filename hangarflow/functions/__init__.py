"""Column functions: no DataFrame, no action, no Python per row."""
