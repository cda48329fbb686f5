"""Readers, synthetic tables and sinks."""
