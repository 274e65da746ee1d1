"""Composed plans and what they share."""
