"""Operators on token streams, windows and their next-token counts."""
