"""flowlens: Spark-native analytics over labelled and scored event tables."""
