"""Readers, sinks and fixture tables."""
