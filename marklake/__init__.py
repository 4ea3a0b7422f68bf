"""marklake: a PySpark-native engine for collections of Markdown records."""
