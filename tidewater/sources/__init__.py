"""sources of the crawl audit engine."""
