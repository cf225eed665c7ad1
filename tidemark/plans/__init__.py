"""Feature tables and indices, composed of operators."""
