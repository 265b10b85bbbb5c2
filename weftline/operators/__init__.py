"""operators of the cross-categorization engine."""
