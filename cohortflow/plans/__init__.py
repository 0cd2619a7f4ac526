"""Registered queries: each a Spark plan and its SQL oracle."""
