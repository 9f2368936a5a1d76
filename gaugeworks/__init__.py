"""Sensor stream analytics and corpus preparation on Spark."""
