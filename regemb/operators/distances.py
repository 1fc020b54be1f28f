"""Median pairwise distance of a bounded sample.

The median heuristic needs the median of all n(n-1)/2 squared distances of
the weighted sample (n <= the sample size, 5,000 by default).  Pairs are
never emitted as rows: Spark tasks each take a block of sample rows, compute
that block's distances to all later rows in numpy, and return only a
histogram.  The exact median is then found by narrowing the histogram range
(usually two passes) until the bins around the middle ranks hold few enough
values to return them.  The sample itself is the broadcast side; its size
is bounded by the sampling operator's ``n``.

Encoded rows are represented as reals ``Z`` (n x R) and discrete codes
``C`` (n x K, -1 = no active column): two rows differing in feature k add 2
to the squared distance when both have a column, 1 when only one has.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regemb.session import ship_package  # noqa: E402

BINS = 1 << 14
FINAL_MAX = 1 << 18
BLOCK = 64
MAX_SAMPLE_BYTES = 256 * 1024 * 1024


def _block_sq_dists(Z, C, s, e):
    """Squared distances of rows ``s..e-1`` to every later row (flattened)."""
    n = Z.shape[0] if Z is not None else C.shape[0]
    out = []
    for i in range(s, e):
        if i + 1 >= n:
            break
        d = np.zeros(n - i - 1)
        if Z is not None and Z.shape[1]:
            diff = Z[i + 1:] - Z[i]
            d += np.einsum("ij,ij->i", diff, diff)
        if C is not None and C.shape[1]:
            a = C[i]
            b = C[i + 1:]
            differ = b != a
            d += (differ * ((a >= 0)[None, :].astype(np.int8) + (b >= 0))).sum(axis=1)
        out.append(d)
    return np.concatenate(out) if out else np.zeros(0)


def _edges(lo: float, hi: float, bins: int) -> np.ndarray:
    e = lo + (hi - lo) * (np.arange(bins + 1, dtype=np.float64) / bins)
    e[0], e[-1] = lo, hi
    return e


def _pass(spark: SparkSession, bc, n: int, lo: float, hi: float, bins: int,
          values: bool) -> pd.DataFrame:
    """One distributed pass over all pairs, restricted to ``lo <= d < hi``.

    Returns rows ``bin=-1`` (count below ``lo``) and either histogram rows
    ``(bin, cnt)`` or, with ``values``, the selected distances with their counts as ``bin=-2``.
    """
    nblocks = max(1, math.ceil(n / BLOCK))

    def run(batches):
        Z, C = bc.value
        edges = _edges(lo, hi, bins)
        for pdf in batches:
            for b in pdf["id"].to_numpy():
                s, e = int(b) * BLOCK, min(n, (int(b) + 1) * BLOCK)
                d = _block_sq_dists(Z, C, s, e)
                below = int((d < lo).sum())
                inr = d[(d >= lo) & (d < hi)]
                if values:
                    u, c = np.unique(inr, return_counts=True)
                    yield pd.DataFrame({"bin": np.full(len(u), -2, dtype=np.int64),
                                        "cnt": c.astype(np.int64), "v": u})
                else:
                    k = np.clip(np.searchsorted(edges, inr, side="right") - 1, 0, bins - 1)
                    h = np.bincount(k, minlength=bins)
                    nz = np.flatnonzero(h)
                    yield pd.DataFrame({"bin": nz.astype(np.int64),
                                        "cnt": h[nz].astype(np.int64), "v": np.zeros(len(nz))})
                yield pd.DataFrame({"bin": [-1], "cnt": [below], "v": [0.0]})

    ship_package(spark)
    parts = min(nblocks, 4 * spark.sparkContext.defaultParallelism)
    res = spark.range(nblocks).repartition(parts).mapInPandas(
        run, "bin long, cnt long, v double")
    if values:
        # at most FINAL_MAX pairs, or the few values of a tied interval, once per block
        return res.toPandas()
    return res.groupBy("bin").agg(F.sum("cnt").alias("cnt")).toPandas()


def exact_pair_median(spark: SparkSession, Z: np.ndarray | None,
                      C: np.ndarray | None = None) -> tuple[int, float]:
    """``(n_pairs, median squared distance)``; the middle two averaged when even."""
    n = Z.shape[0] if Z is not None else C.shape[0]
    N = n * (n - 1) // 2
    if N == 0:
        return 0, float("nan")
    nbytes = (Z.nbytes if Z is not None else 0) + (C.nbytes if C is not None else 0)
    if nbytes > MAX_SAMPLE_BYTES:
        raise ValueError("sample too large to broadcast; lower the sample size")
    bc = spark.sparkContext.broadcast((Z, C))
    ranks = sorted({(N - 1) // 2, N // 2})
    hi = 0.0
    if Z is not None and Z.shape[1]:
        hi += 4.0 * float((Z * Z).sum(axis=1).max())
    if C is not None and C.shape[1]:
        hi += 2.0 * C.shape[1]
    lo, hi = 0.0, hi * (1 + 1e-9) + 1e-9
    found: dict[int, float] = {}
    try:
        while True:
            h = _pass(spark, bc, n, lo, hi, BINS, values=False)
            below = int(h.loc[h["bin"] == -1, "cnt"].sum())
            hist = np.zeros(BINS, dtype=np.int64)
            hb = h[h["bin"] >= 0]
            hist[hb["bin"].to_numpy()] = hb["cnt"].to_numpy()
            cum = below + np.cumsum(hist)
            b_lo = int(np.searchsorted(cum, ranks[0], side="right"))
            b_hi = int(np.searchsorted(cum, ranks[-1], side="right"))
            edges = _edges(lo, hi, BINS)
            inside = int(cum[b_hi] - (cum[b_lo - 1] if b_lo > 0 else below))
            before = (lo, hi)
            lo, hi = float(edges[b_lo]), float(edges[b_hi + 1])
            # ties cannot be narrowed apart: an interval of rounding size holds few values
            if inside <= FINAL_MAX or hi - lo <= 1e-12 * max(1.0, hi) or (lo, hi) == before:
                res = _pass(spark, bc, n, lo, hi, BINS, values=True)
                below2 = int(res.loc[res["bin"] == -1, "cnt"].sum())
                v = res[res["bin"] == -2].groupby("v")["cnt"].sum().sort_index()
                upto = below2 + np.cumsum(v.to_numpy())
                for r in ranks:
                    found[r] = float(v.index[int(np.searchsorted(upto, r, side="right"))])
                break
    finally:
        bc.unpersist()
    return N, sum(found[r] for r in ranks) / len(ranks)


def median_sq_distance_df(spark: SparkSession, sample: DataFrame, vector_col: str) -> DataFrame:
    """A19 over an array column of a (bounded) sample: one row of results."""
    rows = sample.select(F.col(vector_col).cast("array<double>").alias("v")).collect()
    Z = np.array([r[0] for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
    N, med = exact_pair_median(spark, Z)
    return spark.createDataFrame(
        [(len(rows), N, med, math.sqrt(med) if med == med else None)],
        "n_points long, n_pairs long, median_sq_dist double, bandwidth double")


def encoded_sample(stats, skip: set[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The stats sample encoded as (Z, C) on the driver (bounded by its size)."""
    from regemb.operators.encode import encode_sparse
    from regemb.spec import skip_features
    skip = skip_features(stats.spec) if skip is None else skip
    enc = encode_sparse(stats.sample, stats, skip).collect()
    Z = np.array([r["z"] for r in enc], dtype=np.float64).reshape(len(enc), -1)
    C = np.array([[(-1 if v is None else v) for v in r["idx"]] for r in enc],
                 dtype=np.int64).reshape(len(enc), -1)
    return Z, C


def median_heuristic_bandwidth(stats, skip: set[str] | None = None) -> float:
    """M3: sqrt of the median squared distance of the encoded sample."""
    Z, C = encoded_sample(stats, skip)
    spark = stats.totals.sparkSession
    _, med = exact_pair_median(spark, Z, C)
    return math.sqrt(med)


def block_bandwidths(stats, reals: list[str], groups: list[list[str]]) -> list[float]:
    """M5: one bandwidth per block of standardised reals (nulls as 0)."""
    from regemb.operators.encode import standardize
    params = stats.real_params()
    rows = stats.sample.select(*[standardize(F.col(r), *params.get(r, (None, None))).alias(r)
                                 for r in reals]).collect()
    Zall = np.array([[r[c] for c in reals] for r in rows], dtype=np.float64)
    spark = stats.totals.sparkSession
    out = []
    for g in groups:
        cols = [reals.index(c) for c in g]
        _, med = exact_pair_median(spark, Zall[:, cols])
        out.append(math.sqrt(med))
    return out
