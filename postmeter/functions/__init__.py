"""Column rules. Every function takes and returns Spark columns."""
