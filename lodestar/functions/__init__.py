"""Lodestar functions."""
