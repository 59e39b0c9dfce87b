"""lakeops: lakehouse analytics written as plain Spark DataFrame code."""
