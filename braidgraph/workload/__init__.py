"""The queries of this repository over the given tables."""

from braidgraph.workload import (  # noqa: F401, I001
    versions,
    entities,
    relations,
    hierarchy,
    paths,
    vectors,
    overlay,
    governance,
    reports,
    streams,
)
from braidgraph.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
