"""Jobs composed from several operators, and the query catalog."""
