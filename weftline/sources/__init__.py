"""sources of the cross-categorization engine."""
