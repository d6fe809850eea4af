"""Colloquy: Spark-native search, reading and analysis of conversation archives."""
