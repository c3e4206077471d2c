"""Scalar Column -> Column expressions and fixed lookups."""
