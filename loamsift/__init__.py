"""Loamsift: corpus curation on Spark - scans, text and code features, cleaning, masking, metrics, dedup, rollups, reports."""
