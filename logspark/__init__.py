"""A PySpark-native engine for multi-tenant log ingestion and search."""
