"""millrace: analytics over collected web, API and text data, on stock PySpark."""
