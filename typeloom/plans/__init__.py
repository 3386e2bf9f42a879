"""Bindings of the operators to tables, as named queries with SQL."""
