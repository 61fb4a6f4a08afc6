"""plans of the crawl audit engine."""
