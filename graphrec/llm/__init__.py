"""Operators of a training-data pipeline: crawl archives, language, text quality, duplicates, mixing, packing, search."""
