"""Operators for preparing training text: filtering, duplicates, quality, language, contamination and mixing.

Each module is one operator with its own interface; ``queries`` registers them over the given tables. Nothing else in
the package imports this one.
"""
