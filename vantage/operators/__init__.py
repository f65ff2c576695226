"""Skyline, scores and rankings."""
