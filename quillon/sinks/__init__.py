"""What shows a graph outside of Spark."""
