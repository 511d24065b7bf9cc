"""Change-set analytics on PySpark: sources, operators, functions, plans and streaming."""
