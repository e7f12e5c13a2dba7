"""Graph-connected, embedded text on Spark: vectors, links, clusters and ranked search."""
