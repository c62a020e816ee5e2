"""Spark jobs that turn network-flow and sensor logs into evaluated detections."""
