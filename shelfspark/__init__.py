"""shelfspark: catalog discovery and corpus preparation on PySpark."""
