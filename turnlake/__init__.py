"""turnlake: a Spark-native engine for conversational and token-level sequence data."""
