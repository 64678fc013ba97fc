"""cleanloom: a Spark-native engine that prepares tabular exports for import and explains what it did."""
