"""Reading and writing tables, lists and reports."""
