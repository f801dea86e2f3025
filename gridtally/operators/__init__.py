"""Operators on readings and rollups."""
