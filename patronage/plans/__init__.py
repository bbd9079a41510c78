"""Fits and analyses that take several Spark jobs."""
