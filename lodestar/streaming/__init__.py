"""Lodestar streaming."""
