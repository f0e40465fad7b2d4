"""Composite jobs (Z1-Z9), the registered queries and their SQL oracles."""
