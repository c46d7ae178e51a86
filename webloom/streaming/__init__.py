"""webloom.streaming."""
