"""Named metrics. Every function takes a DataFrame and column names, and returns a DataFrame."""
