"""Reading exports and tables, and writing reports."""
