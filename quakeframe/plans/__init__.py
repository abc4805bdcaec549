"""Registered queries: fixture views over the driver's tables, jobs on them, and their SQL oracles."""
