"""Spark-native analytics over sparse, chunked, multi-resolution volumes and the surfaces that cut them."""
