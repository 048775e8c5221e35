"""Registered queries and the SQL that says the same."""
