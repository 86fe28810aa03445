"""Roadside sensor and travel-time analytics as Spark jobs."""
