"""Jobs over the layer tables, and the registry of test queries with their SQL."""
