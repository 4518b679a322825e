"""Spark-native lakehouse tables with snapshots, change feeds and maintenance."""
