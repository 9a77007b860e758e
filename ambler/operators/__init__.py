"""Operators on graphs, frontiers and samples, as DataFrame transformations."""
