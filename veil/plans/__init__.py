"""Plans: applying a policy to a table, jobs over datasets, preset policies."""
