"""globmill: Spark-native analytics over string columns and LIKE patterns."""
