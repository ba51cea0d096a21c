"""Rounding of results, so that the order of floating sums does not show."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def rounded_sql(body: str, columns: str, digits: int = 6) -> str:
    """The same for a statement; adding zero removes the sign of a negative zero."""
    swaps = ", ".join(f"round({c}, {digits}) + CAST(0 AS DOUBLE) AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({swaps}) FROM ({body})"
