"""End-to-end methods and the query catalogue."""
