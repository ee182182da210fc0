"""marlstone: a Spark-native engine for linked-document corpora."""
