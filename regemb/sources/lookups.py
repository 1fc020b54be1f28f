"""Lookup-table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Field-of-degree code table ``code,name,subcat,cat,cat_code``
    (names may hold quoted commas)."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return df.withColumn("code", F.col("code").try_cast("int"))


def read_lookup(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A geography lookup (Parquet or CSV with header)."""
    fmt = fmt or ("csv" if path.endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "csv":
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def read_election(spark: SparkSession, path: str) -> DataFrame:
    """Votes by region (gzip CSV read transparently), integer columns cast."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(c) if c == "region" else F.col(c).try_cast("long").alias(c)
                       for c in df.columns])


def read_crosswalk(spark: SparkSession, path: str, numeric: str) -> DataFrame:
    """A county-PUMA crosswalk CSV whose second line holds labels.

    The label row is the one whose ``numeric`` column is not a number.
    """
    df = spark.read.option("header", True).csv(path)
    return df.where(F.col(numeric).try_cast("int").isNotNull())
