"""Set operations used by the lookup-building steps."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame], allow_missing: bool = True) -> DataFrame:
    """Union by column name; absent columns become null."""
    return functools.reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def augment_alias_rows(df: DataFrame, where: Column, column: str, value) -> DataFrame:
    """Copy the rows matching ``where`` with ``column`` set to ``value``
    and append them (the originals stay)."""
    return df.unionByName(df.where(where).withColumn(column, F.lit(value)))


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """U4: distinct ``(a, b)`` pairs."""
    return df.select(a, b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` not in ``b`` (SQL EXCEPT)."""
    return a.subtract(b)


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    """The two tables hold the same distinct rows."""
    return (a.subtract(b).limit(1).count() == 0) and (b.subtract(a).limit(1).count() == 0)
