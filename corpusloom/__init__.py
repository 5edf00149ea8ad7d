"""corpusloom: a Spark-native analytics engine for versioned, hierarchical document corpora."""
