"""tidemark: a PySpark-native engine for entity time series, statistics and simulation."""
