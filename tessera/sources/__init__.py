"""Readers, built-in table factories, schema discovery and sinks."""
