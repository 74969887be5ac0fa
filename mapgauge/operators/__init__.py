"""Relational operators over pixel, frame and metric tables."""
