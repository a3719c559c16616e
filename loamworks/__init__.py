"""loamworks: a Spark-native engine for mining and curating text."""
