"""webloom.functions."""
