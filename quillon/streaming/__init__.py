"""Incremental panels from streams."""
