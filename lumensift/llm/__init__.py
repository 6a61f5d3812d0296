"""Operators for preparing training text: mixing, deduplication, scoring, scanning, tokenising, formatting.

Nothing outside this folder imports it; ``registry`` is its only entry point.
"""
