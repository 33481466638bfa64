"""Readers, schema adapters and sinks."""
