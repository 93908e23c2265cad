"""Crawl analytics, an inverted index and ranked keyword search on Spark."""

__version__ = "0.1.0"
