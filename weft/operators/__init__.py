"""Relational operators: blocks, refinement, graphs, clusters and metrics."""
