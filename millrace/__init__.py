"""Versioned public-data facts with Spark: normalising, merging, comparing, searching and following them."""
