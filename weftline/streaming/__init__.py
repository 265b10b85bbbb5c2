"""streaming of the cross-categorization engine."""
