"""Reading, writing and the stateful store."""
