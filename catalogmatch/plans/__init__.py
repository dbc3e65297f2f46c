"""Registered queries: inputs from the given tables, calls of the operators, SQL twins."""
