"""skyframe.operators."""
