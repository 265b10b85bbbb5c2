"""functions of the cross-categorization engine."""
