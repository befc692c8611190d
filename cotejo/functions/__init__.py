"""Column functions: every public name takes columns and returns a column."""
