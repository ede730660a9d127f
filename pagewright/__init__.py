"""Page-to-record extraction and catalog analytics on Spark."""
