"""Outfit analytics on Spark: wardrobes, expert ratings, rating models and outfit ranking."""
