"""Scans of landed files and tables."""
