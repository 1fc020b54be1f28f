"""Random Fourier feature embeddings (A10-A13) and their parameters (M1-M5).

The mean of ``[sin(xW); cos(xW)] / sqrt(D)`` over a region's rows (weighted)
approximates the kernel mean embedding of a Gaussian kernel.  ``x`` is the
encoded row: standardised reals plus one-hot levels, so ``xW`` is the real
part ``z @ W[:R]`` plus one row of ``W`` per active level -- a gather, never
a dense one-hot product.

The sums are blocks of :mod:`regemb.operators.onepass`: one scan, one array
per task and region in the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.operators import onepass
from regemb.operators.embed import Embedding
from regemb.operators.encode import feature_count, offsets
from regemb.operators.stats import Stats
from regemb.spec import skip_features


# ---------------------------------------------------------------------------
# M1, M2, M4: frequencies


def gaussian_freqs(n_feats: int, n_freqs: int, bandwidth: float,
                   seed: int | None = None) -> np.ndarray:
    """M1: i.i.d. N(0, 1/bandwidth^2) frequencies, shape (n_feats, n_freqs)."""
    rs = np.random.default_rng(seed)
    return rs.normal(0.0, 1.0 / bandwidth, size=(n_feats, n_freqs))


def orthogonal_freqs(n_feats: int, n_freqs: int, bandwidth: float,
                     seed: int | None = None) -> np.ndarray:
    """M2: orthogonal random features.

    Blocks of ``n_feats`` columns come from the Q factor of a square Gaussian
    matrix (the last block truncated), and every column is scaled by a
    chi(n_feats) length over the bandwidth, so column norms match the
    Gaussian case while columns within a block are orthogonal.  One input
    feature falls back to M1.
    """
    if n_feats == 1:
        return gaussian_freqs(n_feats, n_freqs, bandwidth, seed)
    rs = np.random.default_rng(seed)
    blocks = []
    for _ in range(int(math.ceil(n_freqs / n_feats))):
        qm, _ = np.linalg.qr(rs.normal(size=(n_feats, n_feats)))
        blocks.append(qm.T)
    w = np.concatenate(blocks, axis=1)[:, :n_freqs]
    lengths = np.sqrt(rs.chisquare(n_feats, size=n_freqs)) / bandwidth
    return w * lengths[np.newaxis, :]


def pick_freqs(n_freqs: int, bandwidth: float, n_feats: int, seed: int | None = None,
               orthogonal: bool = True) -> np.ndarray:
    """M4: the frequency draw used when no frequencies are given."""
    f = orthogonal_freqs if orthogonal else gaussian_freqs
    return f(n_feats, n_freqs, bandwidth, seed)


# ---------------------------------------------------------------------------
# Embeddings from block sums


def _names(vals: DataFrame, n_freqs: int, prefix: Column) -> DataFrame:
    sc = F.when(F.col("pos") < n_freqs, F.lit("sin")).otherwise(F.lit("cos"))
    i = (F.col("pos") % n_freqs).cast("string")
    return vals.withColumn("feature_name", F.concat(prefix, F.lit("_"), sc, i))


def full_freqs(stats: Stats, skip: set[str], freqs: np.ndarray | None = None,
               n_freqs: int = 2048, bandwidth: float | None = None, orthogonal: bool = True,
               seed: int | None = None) -> np.ndarray:
    """M4: given frequencies win; else the bandwidth (median heuristic when None,
    M3) and a seeded draw make them.  One row per encoded column."""
    height = feature_count(stats, skip)
    if freqs is None:
        if bandwidth is None:
            from regemb.operators.distances import median_heuristic_bandwidth
            bandwidth = median_heuristic_bandwidth(stats, skip)
        freqs = pick_freqs(n_freqs, bandwidth, height, seed, orthogonal)
    freqs = np.asarray(freqs)
    if freqs.ndim != 2 or freqs.shape[0] != height:
        raise ValueError(f"frequencies need one row per encoded column: {height}, "
                         f"not shape {freqs.shape}")
    return freqs


def full_from_sums(sums: onepass.Sums, block: int, n_freqs: int) -> Embedding:
    """A10 from block sums: positions are sines ``0..D-1``, then cosines ``D..2D-1``."""
    vals = _names(sums.values(block, math.sqrt(n_freqs)), n_freqs, F.lit("rff")).select(
        "region", "subset", "pos", "feature_name", F.lit("rff").alias("feature_id"), "value")
    return Embedding(vals, sums.weights(block), "rff")


def rff_embedding(df: DataFrame, stats: Stats, freqs: np.ndarray | None = None,
                  n_freqs: int = 2048, bandwidth: float | None = None,
                  orthogonal: bool = True, seed: int | None = None,
                  region_col: str = "region", subsets: list[str | Column] | None = None,
                  skip: set[str] | None = None, weight: str | None = None,
                  ordered: dict[str, list[str]] | None = None) -> Embedding:
    """A10: RFF mean embedding over every encoded feature (see :func:`full_freqs`).

    ``ordered`` features use thermometer coding (F3).
    """
    skip = skip_features(stats.spec) if skip is None else skip
    freqs = full_freqs(stats, skip, freqs, n_freqs, bandwidth, orthogonal, seed)
    sums = onepass.block_sums(df, stats, [onepass.fourier_block(stats, freqs, skip, ordered)],
                              region_col, subsets, weight)
    return full_from_sums(sums, 0, freqs.shape[1])


def _real_from_sums(sums: onepass.Sums, block: int, stats: Stats, reals: list[str], n_freqs: int,
                    condition: str | None) -> Embedding:
    ident, scale = "_".join(reals), math.sqrt(n_freqs)
    if not condition:
        vals = _names(sums.values(block, scale), n_freqs, F.lit(ident)).select(
            "region", "subset", "pos", "feature_name", F.lit(f"{ident}_rff").alias("feature_id"),
            "value")
        return Embedding(vals, sums.weights(block), "extra")
    n = stats.sizes()[condition]
    levels = stats.dictionary().where(F.col("feature") == condition).select(
        F.col("rank").cast("int").alias("rank"), "level")
    vals = sums.values(block, scale).select(
        "region", "subset", F.floor(F.col("pos") / n).cast("int").alias("pos"),
        (F.col("pos") % n).alias("rank"), "value").join(levels, "rank")
    vals = _names(vals, n_freqs, F.concat(F.lit(f"{condition}_{ident}_"), F.col("level"))).select(
        "region", "subset", "pos", "feature_name",
        F.lit(f"{condition}_{ident}_rff").alias("feature_id"), "value", "level")
    weights = sums.level_weights(block).join(levels, "rank").select(
        "region", "subset", "level", "weight")
    return Embedding(vals, weights, "extra")


def real_rff_embedding(df: DataFrame, stats: Stats, reals: list[str], freqs: np.ndarray,
                       region_col: str = "region", subsets=None, weight: str | None = None,
                       condition: str | None = None) -> Embedding:
    """A11/A12 (and A13 with ``condition``): RFF of one real or a real pair.

    ``condition`` names a discrete feature: each of its levels gets its own
    embedding normalised by that level's weight (A13), zeros where a region
    or subset has no such row; names are
    ``<d>_<reals>_<level>_<sin|cos><i>``.
    """
    return multi_real_rff(df, stats, [(reals, freqs, condition)], region_col, subsets, weight)[0]


def multi_real_rff(df: DataFrame, stats: Stats,
                   blocks: list[tuple[list[str], np.ndarray, str | None]],
                   region_col: str = "region", subsets: list[str | Column] | None = None,
                   weight: str | None = None) -> list[Embedding]:
    """A11-A13 for many blocks ``(reals, freqs, condition)`` in one scan."""
    made = [onepass.conditional_block(stats, rs, f, c) if c else onepass.real_block(rs, f)
            for rs, f, c in blocks]
    sums = onepass.block_sums(df, stats, made, region_col, subsets, weight)
    return [_real_from_sums(sums, i, stats, rs, np.asarray(f).shape[1], c)
            for i, (rs, f, c) in enumerate(blocks)]


def custom_embedding(df: DataFrame, stats: Stats, features, out_size: int, name: str,
                     region_col: str = "region", subsets: list[str | Column] | None = None,
                     skip: set[str] | None = None, weight: str | None = None) -> Embedding:
    """The weighted mean of a user featurizer over each region/subset.

    ``features(Z, idx)`` receives a chunk of encoded rows -- standardised
    reals ``Z`` (n x R, spec order) and catalogue positions ``idx`` (n x K,
    -1 where a feature has no active column) -- and returns an n x
    ``out_size`` matrix.  It runs inside Arrow batches; Spark partitions the
    rows and sums the partial results.
    """
    skip = skip_features(stats.spec) if skip is None else skip
    first = offsets(stats, skip)
    reals = [r for r in stats.spec.real if r not in skip]
    block = onepass.Custom(reals, list(first), size=out_size, function=features,
                           offsets=list(first.values()))
    sums = onepass.block_sums(df, stats, [block], region_col, subsets, weight)
    vals = sums.values(0).select(
        "region", "subset", "pos",
        F.concat(F.lit(name + "_"), F.col("pos").cast("string")).alias("feature_name"),
        F.lit(name).alias("feature_id"), "value")
    return Embedding(vals, sums.weights(0), name)
