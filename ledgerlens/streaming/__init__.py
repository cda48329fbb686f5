"""Structured Streaming counterparts of the operators."""
