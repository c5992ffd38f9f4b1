"""Terminology analytics as DataFrame operators on Spark."""
