"""Composed jobs (prepare, train, analyze) and the query catalogue."""
