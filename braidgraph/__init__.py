"""Versioned, multi-space knowledge graphs as Spark DataFrames."""

from braidgraph.graph import Graph
from braidgraph.vocabulary import DEFAULT, Vocabulary

__all__ = ["DEFAULT", "Graph", "Vocabulary"]
