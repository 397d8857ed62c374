"""Column functions: geometry, metadata text, tag names, binary values."""
