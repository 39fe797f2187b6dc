"""Typed reading and writing of values, which are stored as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of the strict types.
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
RFC3339 = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?"
    r"([Zz]|[+-][0-9]{2}:[0-9]{2})$"
)
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _checked(column: Column, pattern: str, dtype: str) -> Column:
    return F.when(column.rlike(pattern), column.try_cast(dtype))


def from_text(column: Column, value_type: str) -> Column:
    """Read text as its value type; null when it does not parse."""
    if value_type == "NUMBER":
        return _checked(column, NUMBER, "double")
    if value_type == "BIGINT":
        return _checked(column, INTEGER, "bigint")
    if value_type == "UNSIGNED":
        return F.when(
            column.rlike(r"^[+]?[0-9]+$")
            & (column.try_cast("decimal(38,0)") < F.lit(str(2**64)).cast("decimal(38,0)")),
            column.try_cast("decimal(20,0)"),
        )
    if value_type == "CHECKBOX":
        return F.when(column.isin("true", "false"), column == "true")
    if value_type == "TIME":
        return F.when(column.rlike(RFC3339), F.try_to_timestamp(F.upper(column)))
    return column


def to_text(column: Column, value_type: str) -> Column:
    """Write a typed column as text. Times are written in UTC."""
    if value_type == "TIME":
        return F.date_format(column, TIME_FORMAT)
    return column.cast("string")


def typed_column(column: Column, value_type: str) -> Column:
    """A (value, value_type) pair of a typed column; null for null."""
    return F.when(
        column.isNotNull(),
        F.struct(to_text(column, value_type).alias("value"), F.lit(value_type).alias("value_type")),
    )
