"""PySpark-native filing search, retrieval analytics and training-data operators."""
