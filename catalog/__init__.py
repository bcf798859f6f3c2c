"""Registered queries: each operator run over the given tables, with SQL to check it by."""
