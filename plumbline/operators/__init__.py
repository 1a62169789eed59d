"""operators of the map-grid engine."""
