"""Whole queries over given tables."""
