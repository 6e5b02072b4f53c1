"""Registered query plans over the driver's tables."""
