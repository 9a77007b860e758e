"""Sampling for seeds that arrive as a stream."""
