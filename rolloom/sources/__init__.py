"""Readers of grounding, replies and settings."""
