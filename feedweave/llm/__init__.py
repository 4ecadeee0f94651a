"""Operators for preparing training data, each with its own module, and the queries that apply them."""
