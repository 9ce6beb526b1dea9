"""Analytics operators for vectors, rankings, rasters and corpora, written for Spark."""
