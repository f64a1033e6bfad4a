"""Operators on large record and text collections; nothing else in the library imports this."""
