"""Maintenance as a stream of cycles."""
