"""Sources of filemeta."""
