"""operators of the crawl audit engine."""
