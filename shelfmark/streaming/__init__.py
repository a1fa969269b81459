"""Clicks, conversions and page views: batch rules and the same rules on streams."""
