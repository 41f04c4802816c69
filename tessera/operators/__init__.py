"""Relational operators: rules, joins, constraints, integrity, contracts, statistics, scoring, repair."""
