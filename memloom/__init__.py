"""Memory retrieval, consolidation and corpus preparation on PySpark."""
