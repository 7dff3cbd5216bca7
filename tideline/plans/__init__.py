"""Queries over the supplied tables, by family, each with the SQL that must give the same rows."""
