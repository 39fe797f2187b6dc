"""Column predicates: property filters and version snapshots."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Where:
    """Conditions on one property, all of which must hold.

    Values are strings and compare as strings. With ``numeric=True`` both sides are
    read as decimals and rows that do not parse are dropped.
    """

    eq: str | None = None
    ne: str | None = None
    gt: str | None = None
    gte: str | None = None
    lt: str | None = None
    lte: str | None = None
    any_of: Sequence[str] | None = None
    none_of: Sequence[str] | None = None
    numeric: bool = False

    def on(self, column: Column | str) -> Column:
        column = F.col(column) if isinstance(column, str) else column
        typed = _decimal if self.numeric else (lambda c: c)
        column = typed(column)

        def lit(value):
            return typed(F.lit(str(value)))

        comparisons = {
            "eq": Column.__eq__,
            "ne": Column.__ne__,
            "gt": Column.__gt__,
            "gte": Column.__ge__,
            "lt": Column.__lt__,
            "lte": Column.__le__,
        }
        conditions = [
            compare(column, lit(getattr(self, name)))
            for name, compare in comparisons.items()
            if getattr(self, name) is not None
        ]
        if self.any_of is not None:
            conditions.append(column.isin([lit(v) for v in self.any_of]))
        if self.none_of is not None:
            conditions.append(~column.isin([lit(v) for v in self.none_of]))
        return all_of(conditions)


def _decimal(column: Column) -> Column:
    return column.try_cast("decimal(38,6)")


def is_(value: str) -> Where:
    return Where(eq=value)


def one_of(*values: str) -> Where:
    return Where(any_of=values)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def snapshot(version: str | None = None) -> Column:
    """Rows valid at ``version``, or the open rows when no version is given.

    A row is valid from ``min_version`` up to but not including ``max_version``.
    """
    open_row = F.col("max_version").isNull()
    if version is None:
        return open_row
    return (F.col("min_version") <= version) & (
        open_row | (F.col("max_version") > version)
    )
