"""Plans of filemeta."""
