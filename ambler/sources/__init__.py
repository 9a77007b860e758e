"""Readers and writers of graphs and samples."""
