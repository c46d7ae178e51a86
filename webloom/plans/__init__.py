"""webloom.plans."""
