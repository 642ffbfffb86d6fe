"""Structured Streaming counterparts of parse, dedup, tumble and merge."""
