"""Reading exports and tables, and publishing datasets."""
