"""From a view's SQL to the plans that maintain it."""
