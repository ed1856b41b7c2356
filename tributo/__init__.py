"""tributo: a Spark-native analytics engine for fiscal documents."""
