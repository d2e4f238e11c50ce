"""Set-at-a-time analytics over captured pages, documents, events and rasters on Apache Spark."""
