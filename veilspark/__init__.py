"""Finding, protecting and restoring sensitive data in text and tables, on Spark."""
