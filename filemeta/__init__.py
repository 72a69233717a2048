"""filemeta: media file names and catalogue records as Spark DataFrame transformations."""
