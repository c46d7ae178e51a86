"""webloom.sources."""
