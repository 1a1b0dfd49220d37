"""Observed network statistics as DataFrame operators."""
