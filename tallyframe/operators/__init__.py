"""Reusable DataFrame steps, chained with ``DataFrame.transform``."""
