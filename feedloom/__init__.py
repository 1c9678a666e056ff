"""feedloom: content-feed and research analytics on PySpark."""
