"""Scalar functions on columns: levels, timestamps, JSON texts, dashboard values."""
