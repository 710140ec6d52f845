"""Feederlake: Spark analytics for electricity-distribution networks."""
