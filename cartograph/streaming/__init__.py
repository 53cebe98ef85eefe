"""Incremental site-map refresh with Structured Streaming.

The reference has no streaming operator; its only recurrence is "regenerate
after the site changes". This package does that incrementally: newly
captured pages arrive as files, each micro-batch updates the page index of
the sites it touches and re-renders only their maps.
"""
