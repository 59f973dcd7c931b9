"""skyframe.sources."""
