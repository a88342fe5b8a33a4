"""Readers, panels, caches and sinks."""
