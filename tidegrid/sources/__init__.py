"""Readers: raw key:value text, stage tables, run events, generated sensor days."""
