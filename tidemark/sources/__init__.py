"""Versioned tables, and the plugin classes that feed and drain them."""
