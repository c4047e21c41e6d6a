"""Composed computations over the operators."""
