"""Registered queries: each runs an operator over views of the shared tables, next to the SQL it must equal."""
