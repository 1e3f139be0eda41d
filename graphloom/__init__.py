"""A Spark-native engine from documents to knowledge graphs and retrieval."""
