"""sources of the map-grid engine."""
