"""Windows, distances, joins, hashing and top-k over points(series_id, t, dim, value)."""
