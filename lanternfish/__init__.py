"""PySpark-native analytics over agent session stores and text corpora."""
