"""Sensor and plant telemetry analytics on Spark."""
