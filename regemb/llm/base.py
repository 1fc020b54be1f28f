"""Helpers that the operators share: stored tables, inputs, plain columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regemb.session import scratch_path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder that ``spark.checkpoint.dir`` names."""
    return scratch_path(spark, f"llm-{name}")


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, and later steps
    that use the table several times do not compute it again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text with null counted as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` alone, whatever other columns the table has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_of(text_col).alias("text"))


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id written as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def drawn(*cols: str | Column) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / float(1 << 53)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
