"""plans of the cross-categorization engine."""
