"""Relational operators over DataFrames of places, points and queries."""
