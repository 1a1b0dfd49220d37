"""The nine maximum-entropy models."""
