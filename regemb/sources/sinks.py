"""Sinks and their readers.

Every sink writes Parquet or CSV through the DataFrame writer; nothing is
gathered on the driver.  Small outputs (stats, region weights, exports) are
written as one file for convenience -- their size is bounded by the number
of features and regions, not by the microdata.  ``repartition(1)`` (not
``coalesce(1)``) keeps the aggregation that produces them parallel; only
the final, bounded write is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regemb.operators.embed import Embedding
from regemb.operators.stats import Stats
from regemb.spec import MicrodataSpec


def write_partitioned(df: DataFrame, path: str, region_col: str = "region",
                      mode: str = "errorifexists", max_records_per_file: int = 5_000_000) -> None:
    """One directory per region.

    The ``rebalance`` hint clusters rows by region (so a region gets few
    files) while letting AQE split a skewed partition across several writer
    tasks -- a region holding a third of the data is written in parallel,
    never by one task -- and coalesce tiny ones.  ``maxRecordsPerFile``
    bounds file size.
    """
    (df.hint("rebalance", region_col).write.mode(mode)
       .option("maxRecordsPerFile", max_records_per_file)
       .partitionBy(region_col).parquet(path))


def save_stats(stats: Stats, path: str, mode: str = "errorifexists") -> None:
    """Four small tables under ``path``."""
    stats.totals.repartition(1).write.mode(mode).parquet(f"{path}/totals")
    stats.reals.repartition(1).write.mode(mode).parquet(f"{path}/reals")
    stats.value_counts.repartition(1).write.mode(mode).parquet(f"{path}/value_counts")
    meta = stats.totals.sparkSession.createDataFrame(
        [(stats.spec.name, stats.region_type, stats.sample is not None)],
        "version string, region_type string, has_sample boolean")
    meta.repartition(1).write.mode(mode).parquet(f"{path}/meta")
    if stats.sample is not None:
        stats.sample.repartition(1).write.mode(mode).parquet(f"{path}/sample")


def load_stats(spark: SparkSession, path: str, spec: MicrodataSpec) -> Stats:
    """The stats bundle back; levels ordered by ``(feature, level)``."""
    def rd(name):
        return spark.read.parquet(f"{path}/{name}")
    meta = rd("meta").first()
    sample = rd("sample") if meta["has_sample"] else None
    return Stats(spec, rd("totals"), rd("reals"), rd("value_counts").orderBy("feature", "level"),
                 sample, meta["region_type"])


def save_embedding(emb: Embedding, path: str, overwrite: bool = False,
                   compression: str = "snappy") -> None:
    """Values and weights as Parquet; refuses to overwrite unless asked."""
    mode = "overwrite" if overwrite else "errorifexists"
    emb.values.write.mode(mode).option("compression", compression).parquet(f"{path}/values")
    emb.weights.write.mode(mode).option("compression", compression).parquet(f"{path}/weights")


def load_embedding(spark: SparkSession, path: str, kind: str = "lin") -> Embedding:
    """An embedding written by ``save_embedding``."""
    return Embedding(spark.read.parquet(f"{path}/values"),
                     spark.read.parquet(f"{path}/weights"), kind)


def export_wide(emb: Embedding, names: list[str], path: str, subset: int = 0,
                mode: str = "errorifexists") -> DataFrame:
    """``region`` + one column per feature name, as CSV with a header.

    The pivot values (feature names) are passed explicitly, so no extra
    pass collects them; absent entries are 0.  Single-subset only.
    """
    v = emb.values.where(F.col("subset") == subset)
    wide = v.groupBy("region").pivot("feature_name", names).agg(F.first("value"))
    wide = wide.select("region", *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n)
                                   for n in names])
    wide.repartition(1).sortWithinPartitions("region").write.mode(mode).option("header", True).csv(path)
    return wide


def write_region_weights(emb: Embedding, path: str, subset: int = 0,
                         mode: str = "errorifexists") -> DataFrame:
    """``region,total_wt`` CSV."""
    w = (emb.weights.where(F.col("subset") == subset)
         .select("region", F.col("weight").alias("total_wt")))
    w.repartition(1).sortWithinPartitions("region").write.mode(mode).option("header", True).csv(path)
    return w
