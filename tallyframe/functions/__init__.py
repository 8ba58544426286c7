"""Column expressions used by the reports."""
