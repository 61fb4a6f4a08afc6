"""Tidewater: web-crawl audit analytics and corpus preparation as Spark plans."""
