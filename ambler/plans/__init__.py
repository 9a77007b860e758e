"""Sampling plans: what an app declares, and the loop of joins that runs it."""
