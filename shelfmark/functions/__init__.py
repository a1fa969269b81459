"""Column functions: text, URL, key and rule expressions evaluated inside Spark."""
