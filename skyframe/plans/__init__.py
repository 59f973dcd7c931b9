"""skyframe.plans."""
