"""Interpretable boolean rules and corpus preparation on Spark."""
