"""Column expressions: coordinates, planar geometry, cell indexes, geohash."""
