"""ionloom: a PySpark-native engine for similarity retrieval over measured signals."""
