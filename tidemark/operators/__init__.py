"""Relational operators of the engine: index building, ranking, filters, timestamps."""
