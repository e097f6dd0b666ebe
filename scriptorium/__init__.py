"""A Spark-native engine for analysing and conservatively editing scholarly prose at corpus scale."""
