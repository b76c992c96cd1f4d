"""Sensor-stream risk analytics and corpus operators on Spark."""
