"""quern: a PySpark-native engine for document ingestion, chunking and retrieval analytics."""
