"""functions of the map-grid engine."""
