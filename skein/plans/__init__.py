"""Registered queries, their SQL equivalents and the API."""
