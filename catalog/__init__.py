"""Registered queries over the driver's tables, each with its DuckDB oracle where SQL can express it."""
