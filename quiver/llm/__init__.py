"""Operators a large training-data pipeline needs; nothing outside imports this package."""
