"""Continuous operators over file-change events."""
