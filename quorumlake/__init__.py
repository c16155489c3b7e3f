"""Spark-native analytics for judging, linking and fusing inventories of named entities."""
