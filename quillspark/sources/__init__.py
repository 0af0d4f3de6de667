"""Readers, writers and the Markdown block parser."""
