"""Queries built from the operators, and the SQL that checks them."""
