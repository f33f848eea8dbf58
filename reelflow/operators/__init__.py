"""Operators that are independent of one report: changes, checks, numbering, search."""
