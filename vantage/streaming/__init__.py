"""Skylines of streams."""
