"""Feature encoding (F1-F8) and the feature catalogue.

Rows are never expanded into a dense one-hot matrix.  A row's encoding is

- one standardised value per real feature (F1), and
- one *active level* per discrete feature (F2), or for an ordered feature
  every level up to its own (F3, thermometer).

The catalogue gives each encoded column its position: reals first in spec
order, then each discrete feature (spec order) with its levels sorted as
strings and ``nan`` last (only when the feature has missing values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.operators.lookup import BROADCAST_MAX_BYTES
from regemb.operators.stats import NAN_LEVEL, Stats


def standardize(x: Column, mean: float | None, std: float | None) -> Column:
    """``(x - mean) / std``; null, all-null and zero-spread all give 0."""
    if mean is None or std is None or std == 0:
        return F.lit(0.0)
    z = F.try_divide(x.cast("double") - F.lit(float(mean)), F.lit(float(std)))
    return F.coalesce(z, F.lit(0.0))


def level_of(col: str, with_nan: bool) -> Column:
    """the active level of a discrete column, ``nan`` for null if kept."""
    lv = F.col(col).cast("string")
    return F.coalesce(lv, F.lit(NAN_LEVEL)) if with_nan else lv


def _encoded(stats: Stats, skip: set[str] | None) -> tuple[list[str], list[str]]:
    skip = skip or set()
    return ([r for r in stats.spec.real if r not in skip],
            [d for d in stats.spec.discrete_all if d not in skip])


def offsets(stats: Stats, skip: set[str] | None = None) -> dict[str, int]:
    """First position of every discrete feature (as many entries as the spec has columns)."""
    reals, disc = _encoded(stats, skip)
    sizes, out, at = stats.sizes(), {}, len(reals)
    for d in disc:
        out[d], at = at, at + sizes[d]
    return out


CATALOGUE_SCHEMA = ("pos int, feature_name string, feature_id string, feature string, "
                    "level string, keep boolean")


def catalogue(stats: Stats, skip: set[str] | None = None) -> DataFrame:
    """``(pos, feature_name, feature_id, feature, level, keep)``.

    Reals first in spec order, then each discrete feature in spec order with
    its levels sorted and ``nan`` last; ``keep`` is false on the first level
    of every feature with more than one column (F7).  Ranks come from the
    stored dictionary; only a feature's offset and size are constants.
    """
    spark = stats.totals.sparkSession
    reals, disc = _encoded(stats, skip)
    sizes, first = stats.sizes(), offsets(stats, skip)
    out = spark.createDataFrame([(i, r, r, r, None, True) for i, r in enumerate(reals)],
                                CATALOGUE_SCHEMA)
    if not disc:
        return out
    spans = spark.createDataFrame([(d, first[d], sizes[d]) for d in disc],
                                  "feature string, first int, size int")
    rank = F.col("rank")
    levels = stats.dictionary().join(spans, "feature").select(
        (F.col("first") + rank).cast("int").alias("pos"),
        F.concat_ws("_", "feature", "level").alias("feature_name"),
        F.col("feature").alias("feature_id"), "feature", "level",
        ((rank > 0) | (F.col("size") == 1)).alias("keep"))
    return out.unionByName(levels)


def small_catalogue(stats: Stats, skip: set[str] | None = None) -> DataFrame:
    """The catalogue, broadcast where its counted bytes allow (each level is there three times)."""
    cat = catalogue(stats, skip)
    held = 3 * stats.level_bytes(_encoded(stats, skip)[1])
    return F.broadcast(cat) if held <= BROADCAST_MAX_BYTES else cat


def catalogue_rows(stats: Stats, skip: set[str] | None = None) -> list[tuple]:
    """The catalogue as a listing on the driver, for callers that need column names."""
    return [tuple(r) for r in catalogue(stats, skip).orderBy("pos").collect()]


def feature_count(stats: Stats, skip: set[str] | None = None) -> int:
    """number of encoded columns."""
    reals, disc = _encoded(stats, skip)
    sizes = stats.sizes()
    return len(reals) + sum(sizes[d] for d in disc)


def with_ranks(df: DataFrame, stats: Stats, columns: dict[str, str]) -> DataFrame:
    """Add the rank of each discrete column's active level, null for none.

    ``columns`` maps a feature to the name of its new column.  The stored
    dictionary is joined once per feature, broadcast where its counted bytes
    allow.
    """
    nn = stats.needs_nan()
    for d, out in columns.items():
        ranks = stats.dictionary().where(F.col("feature") == d).select(
            F.col("level").alias(f"__level_{out}"), F.col("rank").cast("int").alias(out))
        if stats.level_bytes([d]) <= BROADCAST_MAX_BYTES:
            ranks = F.broadcast(ranks)
        df = df.join(ranks, level_of(d, nn.get(d, False)) == F.col(f"__level_{out}"),
                     "left").drop(f"__level_{out}")
    return df


def encode_sparse(df: DataFrame, stats: Stats, skip: set[str] | None = None,
                  keep_cols: list[str] | None = None) -> DataFrame:
    """reals as ``z ARRAY<DOUBLE>`` and discrete as ``idx ARRAY<INT>``.

    ``idx`` holds one catalogue position per discrete feature (null where
    the level is missing and the feature has no ``nan`` column, or the level
    was not seen by the stats).
    """
    reals, disc = _encoded(stats, skip)
    params, first = stats.real_params(), offsets(stats, skip)
    ranked = with_ranks(df, stats, {d: f"__rank_{k}" for k, d in enumerate(disc)})
    z = F.array(*[standardize(F.col(r), *params.get(r, (None, None))) for r in reals]) \
        if reals else F.array().cast("array<double>")
    idx = F.array(*[F.col(f"__rank_{k}") + first[d] for k, d in enumerate(disc)]) \
        if disc else F.array().cast("array<int>")
    return ranked.select(*(keep_cols or []), z.alias("z"), idx.alias("idx"))
