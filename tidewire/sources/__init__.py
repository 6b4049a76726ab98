"""Readers for landed feeds, pages and registries, and table writers."""
