"""Lumora: a PySpark-native engine for tile-hand scoring, detection analytics and temporal agreement gates."""
