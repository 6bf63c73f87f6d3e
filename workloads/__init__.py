"""Queries over the test tables, with SQL that states the expected results."""
