"""Embeddings maintained incrementally as microdata files arrive (A3/A8 on a stream).

The reference merges embeddings of separately loaded batches by weight
share.  On a stream the same result comes from keeping *sums* as state: a
streaming ``groupBy(region, subset, feature, level).sum`` over the entry
unpivot (exactly the batch linear embedding's aggregation) in ``complete``
mode, and in ``foreachBatch`` the small state table is divided by the region
weights and written out.  The state is one row per region x encoded column,
so it stays metadata-sized however much data has streamed through.  The
stats (means, stds, levels) are fixed inputs, as they are for ``featurize``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regemb.operators import embed
from regemb.operators.stats import Stats
from regemb.session import scratch_path
from regemb.spec import skip_features


def stream_sums(stream: DataFrame, stats: Stats, region_col: str = "region",
                subsets: list[str | Column] | None = None, skip: set[str] | None = None,
                weight: str | None = None) -> DataFrame:
    """Streaming ``(region, subset, feature, level, s)`` weighted sums."""
    spec = stats.spec
    skip = skip_features(spec) if skip is None else skip
    reals = [r for r in spec.real if r not in skip]
    disc = [d for d in spec.discrete_all if d not in skip]
    entries = embed.entry_array(stats, reals, disc)
    return embed._sums(stream, stats, entries, region_col, weight or spec.weight, subsets,
                       [embed.WEIGHT_KEY] + reals)


def finish_batch(sums: DataFrame, stats: Stats, skip: set[str] | None = None) -> embed.Embedding:
    """Static: state table -> embedding (divide by weight, name columns)."""
    skip = skip_features(stats.spec) if skip is None else skip
    vals, weights = embed._normalise(sums)
    return embed.Embedding(embed.placed(vals, stats, skip), weights)


def start(stream: DataFrame, stats: Stats, out_path: str, checkpoint_location: str | None = None,
          region_col: str = "region", subsets=None, skip: set[str] | None = None,
          available_now: bool = True) -> StreamingQuery:
    """Run the incremental embedding; each trigger rewrites ``out_path``."""
    spark = stream.sparkSession
    ckpt = checkpoint_location or scratch_path(spark, "stream-ckpt")
    sums = stream_sums(stream, stats, region_col, subsets, skip)

    def write(batch: DataFrame, epoch: int) -> None:
        e = finish_batch(batch, stats, skip)
        e.values.write.mode("overwrite").parquet(f"{out_path}/values")
        e.weights.write.mode("overwrite").parquet(f"{out_path}/weights")

    w = (sums.writeStream.outputMode("complete").foreachBatch(write)
             .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def run_to_completion(spark: SparkSession, source_dir: str, schema, stats: Stats,
                      out_path: str, files_per_trigger: int = 1, **kw) -> embed.Embedding:
    """Stream every file under ``source_dir`` (``files_per_trigger`` per micro-batch)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_dir))
    q = start(stream, stats, out_path, **kw)
    q.awaitTermination()
    return embed.Embedding(spark.read.parquet(f"{out_path}/values"),
                           spark.read.parquet(f"{out_path}/weights"))
