"""functions of the crawl audit engine."""
