"""Registered queries over the shared test tables, and the tables they derive."""
