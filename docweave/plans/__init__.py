"""Bindings of tables and the query catalogue."""
