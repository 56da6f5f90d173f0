"""Usage analytics for coding-assistant session logs on Spark."""
