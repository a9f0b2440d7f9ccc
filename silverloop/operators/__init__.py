"""DataFrame operators: cleaning, joins, metrics, sampling, text, vectors, inference."""
