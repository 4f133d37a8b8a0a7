"""Pixel operators on numpy arrays, and the Spark stage that chains them."""
