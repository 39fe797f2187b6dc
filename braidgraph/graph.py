"""The tables of one graph, passed together to the read operators."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from braidgraph.functions.predicates import snapshot
from braidgraph.vocabulary import DEFAULT, Vocabulary


@dataclass(frozen=True)
class Graph:
    triples: DataFrame
    relations: DataFrame
    entities: DataFrame
    vocabulary: Vocabulary = DEFAULT

    def at(self, version: str | None = None) -> "Graph":
        """Keep the triples and relations valid at ``version`` (default: current)."""
        return replace(
            self,
            triples=self.triples.filter(snapshot(version)),
            relations=self.relations.filter(snapshot(version)),
        )
