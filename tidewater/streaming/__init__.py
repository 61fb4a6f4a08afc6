"""streaming of the crawl audit engine."""
