"""Queries over the test tables, by family, each with SQL that gives the same rows."""
