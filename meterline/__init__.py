"""Spark-native analytics over payment-like events: visits, metrics, levels and tariffs."""
