"""Slide containers as DataFrames, and the pyramid file sink."""
