"""lodestone: a Spark-native analytics engine for corpora of code and documents."""
