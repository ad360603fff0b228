"""Spark-native engine for turning motion frames and detections into an audited stock count."""
