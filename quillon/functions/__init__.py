"""Columns with the missing-value rules of panels."""
