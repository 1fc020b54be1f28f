"""The ``featurize`` job: region data + stats -> embeddings.

All built-in featurizers -- linear means, RFF means, the additive extras --
are blocks of one kernel over one scan of the rows
(:mod:`regemb.operators.onepass`); values and weights of every embedding are
read from the stored sums.  A preprocessor (X1) is any ``DataFrame ->
DataFrame`` function applied before encoding; the stats are then recomputed
from its output so rows and counts cannot disagree.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.operators import distances, embed, onepass, rff
from regemb.operators.embed import Embedding
from regemb.operators.encode import small_catalogue
from regemb.operators.stats import Stats, compute_stats
from regemb.spec import MicrodataSpec, skip_features


@dataclass
class RFFConfig:
    """M4: frequencies win; else bandwidth (median heuristic when None) + seed."""

    n_freqs: int = 2048
    freqs: np.ndarray | None = None
    bandwidth: float | None = None
    orthogonal: bool = True
    seed: int | None = None


@dataclass
class ExtrasConfig:
    """X4 additive extras: RFF of single reals and real pairs, RFF of reals
    conditional on discrete levels, and discrete x discrete interactions.

    ``freqs`` may give the draw of a real or a pair, by its tuple of names;
    the others are drawn with one median-heuristic bandwidth each (M5).
    """

    reals: list[str] = field(default_factory=list)
    discretes: list[str] = field(default_factory=list)
    one_n_freqs: int = 128
    pair_n_freqs: int = 256
    seed: int = 0
    freqs: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict)


def extra_freqs(stats: Stats, cfg: ExtrasConfig) -> dict[tuple[str, ...], np.ndarray]:
    """The draw of every real and real pair; all bandwidths come from one read of the sample."""
    groups = [(r,) for r in cfg.reals] + list(itertools.combinations(cfg.reals, 2))
    missing = [g for g in groups if g not in cfg.freqs]
    widths = distances.block_bandwidths(stats, cfg.reals, [list(g) for g in missing]) \
        if missing else []
    children = np.random.SeedSequence(cfg.seed).spawn(len(missing))
    drawn = {g: rff.pick_freqs(cfg.one_n_freqs if len(g) == 1 else cfg.pair_n_freqs, width, len(g),
                               int(child.generate_state(1)[0]))
             for g, width, child in zip(missing, widths, children, strict=True)}
    return {**{g: np.asarray(cfg.freqs[g]) for g in groups if g in cfg.freqs}, **drawn}


@dataclass
class ExtraBlock:
    """One block of the additive vector: where it begins, what it is made of."""

    kind: str                 # real, conditional or levels
    first: int                # offset: sizes of the blocks before it
    names: tuple[str, ...]
    block: onepass.Block
    n_freqs: int = 0
    second: int = 1           # levels that vary fastest


def extra_blocks(stats: Stats, cfg: ExtrasConfig,
                 freqs: dict[tuple[str, ...], np.ndarray]) -> list[ExtraBlock]:
    """Reals, real pairs, reals by level, level pairs, laid end to end."""
    sizes = stats.sizes()
    # one array per draw, so that blocks of one draw are computed together
    freqs = {g: np.ascontiguousarray(f, dtype=np.float64) for g, f in freqs.items()}
    out: list[ExtraBlock] = []
    at = 0

    def add(kind, names, block, n_freqs=0, second=1):
        nonlocal at
        out.append(ExtraBlock(kind, at, names, block, n_freqs, second))
        at += block.size

    for g in [(r,) for r in cfg.reals] + list(itertools.combinations(cfg.reals, 2)):
        add("real", g, onepass.real_block(list(g), freqs[g]), freqs[g].shape[1])
    for r, d in itertools.product(cfg.reals, cfg.discretes):
        if sizes[d]:
            add("conditional", (r, d), onepass.conditional_block(stats, [r], freqs[r,], d),
                freqs[r,].shape[1], sizes[d])
    for d1, d2 in itertools.combinations(cfg.discretes, 2):
        if sizes[d1] * sizes[d2]:
            add("levels", (d1, d2), onepass.pair_block(stats, d1, d2), 0, sizes[d2])
    return out


EXTRA_SCHEMA = ("block int, kind string, first int, size int, n_freqs int, second int, "
                "a string, b string")


def extra_catalogue(stats: Stats, blocks: list[ExtraBlock]) -> DataFrame:
    """F8: ``pos, feature_name, feature_id, level, keep, block`` of the additive vector.

    Positions are offsets (sums of the sizes before) plus the place in the
    block; levels are looked up by rank in the stored dictionary.  ``level``
    is ``<d>=<level>`` where a block has a weight per level.  Only level
    pairs drop their first column (flags go by identity, not by name).
    """
    spark = stats.totals.sparkSession
    laid = spark.createDataFrame(
        [(i, x.kind, x.first, x.block.size, x.n_freqs, x.second, x.names[0],
          x.names[1] if len(x.names) > 1 else None) for i, x in enumerate(blocks)], EXTRA_SCHEMA)
    k, kind = F.col("k"), F.col("kind")
    grid = laid.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("k"))
    grid = grid.withColumns({
        "slow": F.floor(k / F.col("second")), "fast": k % F.col("second"),
        # the features whose levels name the column, if any
        "of_slow": F.when(kind == "levels", F.col("a")),
        "of_fast": F.when(kind.isin("levels", "conditional"), F.col("b"))})
    for side in ("slow", "fast"):
        names = stats.dictionary().select(
            F.col("feature").alias(f"f_{side}"), F.col("rank").alias(f"r_{side}"),
            F.col("level").alias(f"level_{side}"))
        grid = grid.join(names, (F.col(f"of_{side}") == F.col(f"f_{side}"))
                         & (F.col(side) == F.col(f"r_{side}")), "left")
    wave = F.concat(F.when(F.col("slow") < F.col("n_freqs"), "sin").otherwise("cos"),
                    (F.col("slow") % F.col("n_freqs")).cast("string"))
    pair = F.concat_ws("_", "a", "b")
    cond = F.concat_ws("_", "b", "a")
    return grid.select(
        (F.col("first") + k).cast("int").alias("pos"),
        F.when(kind == "real", F.concat_ws("_", pair, wave))
         .when(kind == "conditional", F.concat_ws("_", cond, "level_fast", wave))
         .otherwise(F.concat_ws("_", pair, "level_slow", "level_fast")).alias("feature_name"),
        F.when(kind == "real", F.concat(pair, F.lit("_rff")))
         .when(kind == "conditional", F.concat(cond, F.lit("_rff")))
         .otherwise(pair).alias("feature_id"),
        F.when(kind == "conditional", F.concat_ws("=", "b", "level_fast")).alias("level"),
        ((kind != "levels") | (k > 0) | (F.col("size") == 1)).alias("keep"), "block")


def additive_from_sums(sums: onepass.Sums, first: int, stats: Stats,
                       blocks: list[ExtraBlock]) -> Embedding:
    """One vector per region and subset, blocks at their offsets.

    The weights table has a row without a level for the blocks that share the
    region's weight, and one per level for conditional blocks, so a roll-up
    (A15) weighs each level by itself.
    """
    spark = stats.totals.sparkSession
    vals = None
    for i, x in enumerate(blocks):
        v = sums.values(first + i, math.sqrt(x.n_freqs) if x.n_freqs else 1.0).withColumn(
            "pos", F.col("pos") + F.lit(x.first))
        vals = v if vals is None else vals.unionByName(v)
    plain = next((first + i for i, x in enumerate(blocks) if x.kind != "conditional"), None)
    none = F.lit(None).cast("string")
    weights = None
    if plain is not None:
        weights = sums.weights(plain).select("region", "subset", none.alias("level"), "weight")
    seen = set()
    for i, x in enumerate(blocks):
        if x.kind != "conditional" or x.names[1] in seen:
            continue
        seen.add(x.names[1])
        names = stats.dictionary().where(F.col("feature") == x.names[1]).select(
            F.col("rank").cast("int").alias("rank"),
            F.concat_ws("=", "feature", "level").alias("level"))
        w = sums.level_weights(first + i).join(names, "rank").select(
            "region", "subset", "level", "weight")
        weights = w if weights is None else weights.unionByName(w)
    if vals is None:
        return Embedding(
            spark.createDataFrame([], "region string, subset int, pos int, feature_name string, "
                                      "feature_id string, value double, level string"),
            spark.createDataFrame([], "region string, subset int, level string, weight double"),
            "extra")
    cat = extra_catalogue(stats, blocks).select("pos", "feature_name", "feature_id", "level")
    vals = vals.join(cat, "pos").select("region", "subset", "pos", "feature_name", "feature_id",
                                        "value", "level")
    return Embedding(vals, weights, "extra")


def additive_extras(df: DataFrame, stats: Stats, cfg: ExtrasConfig, region_col: str = "region",
                    subsets: list[str | Column] | None = None) -> Embedding:
    """A11-A14 as one additive vector, from one scan."""
    blocks = extra_blocks(stats, cfg, extra_freqs(stats, cfg))
    sums = onepass.block_sums(df, stats, [x.block for x in blocks], region_col, subsets)
    return additive_from_sums(sums, 0, stats, blocks)


def featurize(df: DataFrame, stats: Stats | None = None, spec: MicrodataSpec | None = None,
              region_col: str = "region", subsets: list[str | Column] | None = None,
              linear: bool = True, rff_config: RFFConfig | None = None,
              extras_config: ExtrasConfig | None = None,
              preprocessor: Callable[[DataFrame], DataFrame] | None = None,
              skip: set[str] | None = None,
              ordered: dict[str, list[str] | None] | None = None,
              prefilter: bool = False) -> dict[str, Embedding]:
    """Embeddings of every region: ``{"lin": ..., "rff": ..., "extra": ...}``.

    Every region has a value for every subset, 0 where it has no such row; with
    ``prefilter`` only the rows of the subsets are read, and regions without any
    are absent.

    Linear, RFF and extras come from one scan.  Thermometer coding of the
    linear means (``ordered``) has a column for every level up to a row's own
    and is summed in SQL, which is a second scan.
    """
    if preprocessor is not None:
        df = df.transform(preprocessor)
        if spec is None:
            raise ValueError("a preprocessor needs the output spec to recompute stats")
        stats = compute_stats(df, spec, sample_size=5000)
    if stats is None:
        stats = compute_stats(df, spec, sample_size=5000)
    skip = skip_features(stats.spec) if skip is None else skip
    df = embed.members_only(df, subsets) if prefilter else df
    blocks: list[onepass.Block] = []
    at: dict[str, int] = {}
    if linear and not ordered:
        at["lin"] = len(blocks)
        blocks.append(onepass.linear_block(stats, skip))
    n_freqs = 0
    if rff_config is not None:
        c = rff_config
        freqs = rff.full_freqs(stats, skip, c.freqs, c.n_freqs, c.bandwidth, c.orthogonal, c.seed)
        n_freqs = freqs.shape[1]
        at["rff"] = len(blocks)
        blocks.append(onepass.fourier_block(stats, freqs, skip))
    extra: list[ExtraBlock] = []
    if extras_config is not None:
        extra = extra_blocks(stats, extras_config, extra_freqs(stats, extras_config))
        at["extra"] = len(blocks)
        blocks += [x.block for x in extra]
    out: dict[str, Embedding] = {}
    if linear and ordered:
        out["lin"] = embed.linear_embedding(df, stats, region_col, subsets, skip, ordered)
    if not blocks:
        return out
    sums = onepass.block_sums(df, stats, blocks, region_col, subsets)
    if "lin" in at:
        cat = small_catalogue(stats, skip).select("pos", "feature_name", "feature_id")
        out["lin"] = Embedding(
            sums.values(at["lin"]).join(cat, "pos").select(
                "region", "subset", "pos", "feature_name", "feature_id", "value"),
            sums.weights(at["lin"]), "lin")
    if "rff" in at:
        out["rff"] = rff.full_from_sums(sums, at["rff"], n_freqs)
    if "extra" in at:
        out["extra"] = additive_from_sums(sums, at["extra"], stats, extra)
    return out
