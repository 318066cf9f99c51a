"""A Spark-native engine for bisulfite-sequencing data."""
