"""Continuous ingestion of images."""
