"""Readers, parsers and table views."""
