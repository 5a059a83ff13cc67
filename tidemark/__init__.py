"""Drift analytics on Spark: tracks, error tables, shift statistics, detectors."""
