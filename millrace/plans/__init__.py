"""Whole plans: build, crawl, evaluate."""
