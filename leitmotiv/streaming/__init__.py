"""Motifs over a stream of points."""
