"""Registered queries and, beside each, the same question in SQL."""
