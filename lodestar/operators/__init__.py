"""Lodestar operators."""
