"""Weighted mean embeddings per region and subset.

Every row is unpivoted into *entries* ``(feature, level, value)``:

- one weight entry ``(__w__, null, w)``,
- one entry per real feature ``(real, null, w * z)``,
- one entry per discrete feature ``(feature, level, w)`` (F2), or for an
  ordered feature one entry per level up to its own (F3), and
- optional interaction entries ``(d1_d2, l1, l2, w)`` (A14).

A single ``groupBy(region, subset, feature, level, level2).sum`` (partially
aggregated map-side) gives all weighted sums in one scan and one shuffle of
at most tasks x regions x encoded-columns rows.  A window over the small
result divides by the region/subset weight; a zero total weight leaves 0.
Subsets (P10/A7) are SQL predicates; a row joins every subset it satisfies
and adds weight 0 to the others, so an empty subset has a row too.

A hot region (say a third of all rows) only enlarges the map-side combine;
the shuffle key includes feature and level, so no single reducer receives
the hot region's rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regemb.operators.encode import catalogue, level_of, small_catalogue, standardize
from regemb.operators.stats import NAN_LEVEL, Stats
from regemb.session import stored
from regemb.spec import skip_features

WEIGHT_KEY = "__w__"
ENTRY = "struct<feature:string,level:string,level2:string,val:double>"


@dataclass
class Embedding:
    """Long-form embedding plus region weights."""

    values: DataFrame   # region, subset, pos, feature_name, feature_id, value
    weights: DataFrame  # region, subset, weight
    kind: str = "lin"


def predicate(p: str | Column) -> Column:
    return F.expr(p) if isinstance(p, str) else p


def subset_flags(subsets: list[str | Column] | None) -> list[Column]:
    """P10: one boolean per subset; a null predicate counts as false."""
    return [F.coalesce(predicate(p), F.lit(False)) for p in subsets] if subsets else [F.lit(True)]


def members_only(df: DataFrame, subsets: list[str | Column] | None) -> DataFrame:
    """Rows of any subset: the plain ``OR`` of the predicates, which Catalyst can push
    into the scan.  Regions without such a row are then absent instead of 0."""
    if not subsets:
        return df
    return df.where(functools.reduce(lambda a, b: a | b, map(predicate, subsets)))


def weight_col(weight: str) -> Column:
    return F.coalesce(F.col(weight).cast("double"), F.lit(0.0))


def _entry(feature: str | Column, level: Column | None, val: Column,
           level2: Column | None = None) -> Column:
    f = F.lit(feature) if isinstance(feature, str) else feature
    none = F.lit(None).cast("string")
    return F.struct(f.alias("feature"), (none if level is None else level).alias("level"),
                    (none if level2 is None else level2).alias("level2"),
                    val.cast("double").alias("val"))


def ordered_levels(stats: Stats, feature: str) -> list[str]:
    return stats.levels().get(feature, [])


def entry_array(stats: Stats, reals: list[str], disc: list[str],
                ordered: dict[str, list[str]] | None = None,
                pairs: list[tuple[str, str]] | None = None,
                w: Column | None = None) -> Column:
    w = F.col("_w") if w is None else w
    params = stats.real_params()
    nn = stats.needs_nan()
    ordered = ordered or {}
    fixed = [_entry(WEIGHT_KEY, None, w)]
    fixed += [_entry(r, None, w * standardize(F.col(r), *params.get(r, (None, None))))
              for r in reals]
    fixed += [_entry(d, level_of(d, nn.get(d, False)), w) for d in disc if d not in ordered]
    for d1, d2 in pairs or []:
        l1, l2 = level_of(d1, nn.get(d1, False)), level_of(d2, nn.get(d2, False))
        both = l1.isNotNull() & l2.isNotNull()
        fixed.append(_entry(f"{d1}_{d2}", F.when(both, l1), w, F.when(both, l2)))
    arr = F.array(*fixed)
    for d, levels in ordered.items():
        # level k switches on columns 1..k; a missing or unknown level none
        lv = F.array(*[F.lit(x) for x in levels])
        k = F.array_position(lv, F.col(d).cast("string")).cast("int")
        thermo = F.transform(F.slice(lv, 1, F.greatest(k, F.lit(0)).cast("int")) if levels
                             else F.array().cast("array<string>"),
                             lambda x: _entry(d, x, w))
        arr = F.concat(arr, F.when(k > 0, thermo).otherwise(F.array().cast(f"array<{ENTRY}>")))
    return arr


def _sums(df, stats, entries, region_col, weight, subsets, valueless: list[str]):
    base = df.select(
        F.col(region_col).alias("region"),
        *[F.col(c) for c in df.columns if c not in (region_col, "region", "subset")],
        weight_col(weight).alias("_w"))
    if subsets:
        flags = F.array(*[F.struct(F.lit(i).alias("subset"), f.alias("_member"))
                          for i, f in enumerate(subset_flags(subsets))])
        base = base.select("*", F.inline(flags))
        absent = F.array(_entry(WEIGHT_KEY, None, F.lit(0.0)))
        entries = F.when(F.col("_member"), entries).otherwise(absent.cast(f"array<{ENTRY}>"))
    else:
        base = base.withColumn("subset", F.lit(0))
    ex = base.select("region", "subset", F.inline(entries))
    keep = F.col("level").isNotNull() | F.col("feature").isin(valueless)
    return (ex.where(F.col("val").isNotNull() & keep)
              .groupBy("region", "subset", "feature", "level", "level2")
              .agg(F.sum("val").alias("s")))


def _normalise(sums: DataFrame) -> tuple[DataFrame, DataFrame]:
    wnd = Window.partitionBy("region", "subset")
    g = sums.withColumn(
        "weight", F.coalesce(F.sum(F.when(F.col("feature") == WEIGHT_KEY, F.col("s"))).over(wnd),
                             F.lit(0.0)))
    weights = g.where(F.col("feature") == WEIGHT_KEY).select("region", "subset", "weight")
    vals = (g.where(F.col("feature") != WEIGHT_KEY)
             .withColumn("value", F.coalesce(F.try_divide(F.col("s"), F.col("weight")),
                                             F.lit(0.0))))
    return vals, weights


def linear_embedding(df: DataFrame, stats: Stats, region_col: str = "region",
                     subsets: list[str | Column] | None = None,
                     skip: set[str] | None = None,
                     ordered: dict[str, list[str] | None] | None = None,
                     weight: str | None = None, prefilter: bool = False) -> Embedding:
    """A6 (+A7, A9, F3): weighted mean of the encoded rows per region/subset.

    ``ordered`` maps a discrete feature to its ordered level list (``None``:
    the stats' sorted levels); such features use thermometer coding.
    ``prefilter`` reads the rows of the subsets only (:func:`members_only`).
    """
    df = members_only(df, subsets) if prefilter else df
    spec = stats.spec
    skip = skip_features(spec) if skip is None else skip
    weight = weight or spec.weight
    reals = [r for r in spec.real if r not in skip]
    disc = [d for d in spec.discrete_all if d not in skip]
    ordered = {d: (lv if lv is not None else ordered_levels(stats, d))
               for d, lv in (ordered or {}).items()}
    entries = entry_array(stats, reals, disc, ordered)
    sums = _sums(df, stats, entries, region_col, weight, subsets, [WEIGHT_KEY] + reals)
    vals, weights = _normalise(sums)
    return Embedding(placed(vals, stats, skip), weights, "lin")


def placed(vals: DataFrame, stats: Stats, skip: set[str]) -> DataFrame:
    """Values by feature and level to positions and names of the catalogue."""
    cat = small_catalogue(stats, skip)
    return (vals.join(cat, (vals.feature == cat.feature) & vals.level.eqNullSafe(cat.level))
                .select("region", "subset", "pos", "feature_name", "feature_id", "value"))


def drop_collinear(emb: Embedding, stats: Stats, skip: set[str] | None = None) -> Embedding:
    """drop the first level of every multi-level one-hot block (W3 ``keep``)."""
    skip = skip_features(stats.spec) if skip is None else skip
    dropped = catalogue(stats, skip).where(~F.col("keep")).select("pos")
    return Embedding(emb.values.join(dropped, "pos", "left_anti").select(*emb.values.columns),
                     emb.weights, emb.kind)


def pair_catalogue(stats: Stats, pairs: list[tuple[str, str]]) -> DataFrame:
    """F8: ``pos, feature_name, feature_id, feature, level, level2, keep`` of level pairs.

    Pair by pair, levels in catalogue order.  Positions are laid out from the
    features' sizes and their levels looked up by rank, so no levels are
    crossed on the driver or in a join.  The first column of a pair with
    several is not kept (W3).
    """
    spark = stats.totals.sparkSession
    sizes, at, rows = stats.sizes(), 0, []
    for d1, d2 in pairs:
        n1, n2 = sizes[d1], sizes[d2]
        if n1 * n2:
            rows.append((at, n1 * n2, n2, d1, d2))
        at += n1 * n2
    blocks = spark.createDataFrame(rows, "first int, size int, n2 int, d1 string, d2 string")
    grid = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("k"))
    first, second = (stats.dictionary().select(
        F.col("feature").alias(f"f{i}"), F.col("rank").alias(f"r{i}"), F.col("level").alias(name))
        for i, name in ((1, "level"), (2, "level2")))
    name = F.concat_ws("_", "d1", "d2")
    return (grid.join(first, (F.col("d1") == F.col("f1"))
                      & (F.floor(F.col("k") / F.col("n2")) == F.col("r1")))
                .join(second, (F.col("d2") == F.col("f2"))
                      & (F.col("k") % F.col("n2") == F.col("r2")))
                .select((F.col("first") + F.col("k")).alias("pos"),
                        F.concat_ws("_", name, "level", "level2").alias("feature_name"),
                        name.alias("feature_id"), name.alias("feature"), "level", "level2",
                        ((F.col("k") > 0) | (F.col("size") == 1)).alias("keep")))


def _dense_pairs(vals: DataFrame, weights: DataFrame, stats: Stats,
                 pairs: list[tuple[str, str]]) -> DataFrame:
    """Every level pair of every region and subset; pairs that do not occur are 0."""
    cat = pair_catalogue(stats, pairs)
    n = sum(stats.sizes()[a] * stats.sizes()[b] for a, b in pairs)
    where = cat.select("pos", *[F.col(c).alias(f"c_{c}") for c in ("feature", "level", "level2")])
    found = vals.join(where, (F.col("feature") == F.col("c_feature"))
                      & (F.col("level") == F.col("c_level"))
                      & (F.col("level2") == F.col("c_level2"))).select(
        F.col("region").alias("v_region"), F.col("subset").alias("v_subset"),
        F.col("pos").alias("v_pos"), "value")
    grid = weights.select("region", "subset",
                          F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos")) \
        if n else weights.select("region", "subset", F.lit(0).alias("pos")).limit(0)
    return (grid.join(found, F.col("region").eqNullSafe(F.col("v_region"))
                      & (F.col("subset") == F.col("v_subset")) & (F.col("pos") == F.col("v_pos")),
                      "left")
                .join(cat.select("pos", "feature_name", "feature_id"), "pos")
                .select("region", "subset", "pos", "feature_name", "feature_id",
                        F.coalesce("value", F.lit(0.0)).alias("value")))


def interaction_embedding(df: DataFrame, stats: Stats, pairs: list[tuple[str, str]],
                          region_col: str = "region",
                          subsets: list[str | Column] | None = None,
                          weight: str | None = None) -> Embedding:
    """Share of weight in each level pair of two discrete features.

    Names ``<d1>_<d2>_<l1>_<l2>``, identity ``<d1>_<d2>``.  Every pair of
    levels has a row; pairs that never occur have the share 0.
    """
    spec = stats.spec
    weight = weight or spec.weight
    entries = entry_array(stats, [], [], None, pairs)
    sums = _sums(df, stats, entries, region_col, weight, subsets, [WEIGHT_KEY])
    vals, weights = _normalise(sums)
    return Embedding(_dense_pairs(vals, weights, stats, pairs), weights, "extra")


def linear_with_interactions(df: DataFrame, stats: Stats, pairs: list[tuple[str, str]],
                             region_col: str = "region",
                             subsets: list[str | Column] | None = None,
                             skip: set[str] | None = None,
                             weight: str | None = None) -> tuple[Embedding, Embedding]:
    """The linear embedding (A6) and level-pair shares (A14) in one pass.

    Both featurizers are entry sums, so their entry arrays are concatenated
    and a single scan + ``groupBy`` serves both; the outputs are split by
    feature afterwards.  Same results as the two separate calls.
    """
    spec = stats.spec
    skip = skip_features(spec) if skip is None else skip
    weight = weight or spec.weight
    reals = [r for r in spec.real if r not in skip]
    disc = [d for d in spec.discrete_all if d not in skip]
    entries = entry_array(stats, reals, disc, None, pairs)
    sums = stored(_sums(df, stats, entries, region_col, weight, subsets, [WEIGHT_KEY] + reals),
                  "sums")
    vals, weights = _normalise(sums)
    is_pair = F.col("feature").isin([f"{a}_{b}" for a, b in pairs])
    return (Embedding(placed(vals.where(~is_pair), stats, skip), weights, "lin"),
            Embedding(_dense_pairs(vals.where(is_pair), weights, stats, pairs), weights, "extra"))


def region_weights(df: DataFrame, weight: str, region_col: str = "region",
                   subsets: list[str | Column] | None = None) -> DataFrame:
    """Total weight per region and subset; a subset without rows weighs 0."""
    w = weight_col(weight)
    sums = df.groupBy(F.col(region_col).alias("region")).agg(*[
        F.sum(F.when(f, w).otherwise(0.0)).alias(f"w{i}")
        for i, f in enumerate(subset_flags(subsets))])
    n = len(subsets or [0])
    return sums.select("region", F.inline(F.array(*[
        F.struct(F.lit(i).alias("subset"), F.col(f"w{i}").alias("weight")) for i in range(n)])))


def merge_batches(batch_values: DataFrame, batch_weights: DataFrame,
                  keys: tuple[str, ...] = ("region", "subset")) -> Embedding:
    """Recombine embeddings of separately processed batches.

    Each batch's mean is weighted by its share of the region weight:
    ``sum(w_b * v_b) / sum(w_b)`` per ``(region, subset, pos)``.  Inputs carry
    a ``batch`` column; values ``(batch, region, subset, pos, ..., value)``
    and weights ``(batch, region, subset, weight)``.
    """
    k = list(keys)
    joined = batch_values.join(batch_weights, k + ["batch"])
    desc = [c for c in batch_values.columns if c not in k + ["batch", "value", "pos"]]
    vals = (joined.groupBy(*k, "pos", *desc)
                  .agg(F.sum(F.col("weight") * F.col("value")).alias("_sv")))
    w = batch_weights.groupBy(*k).agg(F.sum("weight").alias("weight"))
    out = (vals.join(w, k)
               .select(*k, "pos", *desc,
                       F.coalesce(F.try_divide(F.col("_sv"), F.col("weight")),
                                  F.lit(0.0)).alias("value")))
    return Embedding(out, w)


__all__ = ["Embedding", "linear_embedding", "interaction_embedding", "region_weights",
           "merge_batches", "NAN_LEVEL"]
