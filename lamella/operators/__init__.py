"""DataFrame operators: series choice, tile grids and lookups, pyramids, output layout."""
