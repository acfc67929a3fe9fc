"""Relational operators: joins with checked broadcast and salting, containment join, link joins, predicates, aggregates, sentiment, ranking and the response budget."""
