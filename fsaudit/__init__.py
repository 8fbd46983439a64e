"""Filesystem audit on Spark: crawl, index, find, roll up, report, purge."""
