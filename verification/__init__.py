"""Registered queries and their SQL counterparts for the correctness check."""
