"""skyframe.streaming."""
