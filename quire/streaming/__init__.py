"""Structured Streaming jobs: drop-folder load, payload harvest, key dedup."""
