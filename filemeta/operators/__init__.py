"""Operators of filemeta."""
