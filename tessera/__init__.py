"""tessera: a Spark-native index and query engine for large text and code corpora."""
