"""Table operators: every public name takes DataFrames and returns a DataFrame."""
