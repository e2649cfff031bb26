"""streaming of the graph engine."""
