"""Relational operators: outline traversal, keyword and vector ranking, fusion."""
