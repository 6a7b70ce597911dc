"""Plans: the catalog of named queries."""
