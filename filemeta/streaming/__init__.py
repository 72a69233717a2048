"""Streaming of filemeta."""
