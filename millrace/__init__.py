"""A Spark-native engine for pipeline queries, change logs, schemas and reports."""
