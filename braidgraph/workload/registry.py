"""Named queries over the given tables and the SQL that checks them."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from braidgraph.workload import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, **views: str) -> Callable[[Query], Query]:
    """Register a query under its function name, with the text DuckDB runs.

    ``views`` are further named texts the oracle uses.
    """

    def register(function: Query) -> Query:
        name = function.__name__

        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Times are written and read as UTC, whatever the zone of the session was.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = fixtures.with_views(oracle, extra=views)
        return function

    return register
