"""Column-returning functions: names, paths, routes, search terms, predicates."""
