"""Readers and demonstration networks."""
