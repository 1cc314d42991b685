"""Readers to points(series_id, t, dim, value), generators, and writers."""
