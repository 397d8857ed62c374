"""Lamella: slide-pyramid planning, inspection and building as Spark DataFrame jobs."""
