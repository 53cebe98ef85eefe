"""Readers, derived fixture tables and sinks."""
