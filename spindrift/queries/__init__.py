"""Queries of the library."""
