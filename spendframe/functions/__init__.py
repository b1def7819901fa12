"""Column-level building blocks: dotted paths, predicates, periods and money."""
