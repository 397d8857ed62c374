"""Batch plans over many slides, and the registered queries."""
