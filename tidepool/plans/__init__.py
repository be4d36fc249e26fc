"""Whole pipelines, and the reads that the driver's text tables stand for."""
