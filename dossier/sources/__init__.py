"""Readers, page and record parsers, and sinks."""
