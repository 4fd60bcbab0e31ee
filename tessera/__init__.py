"""Spark-native engine for indexed, packetised audiovisual data."""
