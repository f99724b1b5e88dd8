"""News coverage jobs on Spark: articles and a watchlist in, per-company story tables out."""
