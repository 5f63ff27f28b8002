"""Registered queries and their check SQL."""
