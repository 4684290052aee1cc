"""DataFrame in, DataFrame out: the questions asked about tables."""
