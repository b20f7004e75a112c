"""Spark jobs for next-token statistics over large token streams."""
