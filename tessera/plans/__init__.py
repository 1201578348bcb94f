"""Query plans: storage of intermediate tables, adapters, and the query registry."""
