"""plans of the map-grid engine."""
