"""Functions of filemeta."""
