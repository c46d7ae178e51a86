"""webloom.operators."""
