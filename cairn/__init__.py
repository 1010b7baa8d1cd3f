"""A Spark-native engine for search-trace analytics and corpus preparation."""
