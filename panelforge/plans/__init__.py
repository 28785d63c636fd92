"""Forecast and evaluation plans, and the catalogue of queries."""
