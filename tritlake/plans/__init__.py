"""Whole plans: the index API, the queries over the fixture tables and their SQL."""
