"""Streaming maintenance of node sequences."""
