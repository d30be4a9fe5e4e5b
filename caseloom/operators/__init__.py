"""The relational operators: sources, natural join of cases, maps, tuples and gathers."""
