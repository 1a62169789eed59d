"""streaming of the map-grid engine."""
