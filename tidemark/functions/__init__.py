"""Part of tidemark; see the README for the map of operators."""
