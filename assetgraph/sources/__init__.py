"""Readers: repository trees, tables."""
