"""Palimpsest: a Spark-native engine for conversational fact memories."""
