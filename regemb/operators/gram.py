"""Ridge and probit regression from sums of products (M7, M8, K5).

The fits read the rows only through weighted sums of products of the design's
columns.  Each task adds up ``A = [1, x, y]' W [1, x, y]`` over its rows and
hands it on in tiles of :data:`TILE` columns; tiles are added by key, so the
shuffle has one row per task and tile.  What reaches the driver is the sum,
``(p + 2)^2`` numbers, bounded by the number of columns (:data:`MAX_COLUMNS`).

* :func:`ridge` solves once for any penalty; :func:`ridge_loo` picks the penalty
  by exact leave-one-out errors, which take one more pass over the rows.
* :func:`probit` repeats the sums with the weights and working responses of the
  current fit (Fisher scoring) until nothing moves.

The intercept is not penalised.  Rows without a label or with weight 0 do not
count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.operators.stats import hash_uniform
from regemb.session import ship_package

TILE = 256
MAX_COLUMNS = 4096       # of a design; beyond, use the L-BFGS fits of regress.py
ROWS = 1024


@dataclass
class Sums:
    """``[1, x, y]' W [1, x, y]`` and the number of rows."""

    matrix: np.ndarray
    rows: int

    @property
    def columns(self) -> int:
        return len(self.matrix) - 2


@dataclass
class Fit:
    """Intercept and coefficients; ``link`` maps the linear predictor to a share."""

    intercept: float
    coef: np.ndarray
    penalty: float
    link: str = "identity"

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with its prediction."""
        fit = self
        ship_package(df.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                eta = _matrix(b.column("__x"), len(fit.coef)) @ fit.coef + fit.intercept
                value = eta if fit.link == "identity" else normal_cdf(eta)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in b.schema.names if c != "__x"], pa.array(value)],
                    names=[*[c for c in b.schema.names if c != "__x"], out])
        kept = [c for c in df.columns if c != "features"]
        schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in kept)
        return df.select(*kept, vector_to_array("features").alias("__x")).mapInArrow(
            run, f"{schema}, {out} double")


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution function."""
    return np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in np.ravel(x)]).reshape(np.shape(x))


def _matrix(x: pa.ListArray, p: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), p)


TILES = "i int, j int, rows long, s array<double>"


def _tiles_kernel(p: int, working: Callable | None):
    """Rows ``x, y, w`` to tiles of their products; ``working`` maps (eta's inputs) to (z, w)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((p + 2, p + 2)), 0
        for b in batches:
            x = _matrix(b.column("x"), p)
            y, w = b.column("y").to_numpy(), b.column("w").to_numpy()
            if working is not None:
                y, w = working(x, y, w)
            for s in range(0, len(x), ROWS):
                a = np.column_stack([np.ones(len(x[s:s + ROWS])), x[s:s + ROWS], y[s:s + ROWS]])
                total += a.T @ (a * w[s:s + ROWS, None])
            n += len(x)
        if not n:
            return
        for i in range(0, p + 2, TILE):
            for j in range(i, p + 2, TILE):
                part = total[i:i + TILE, j:j + TILE].reshape(-1)
                yield pa.RecordBatch.from_pydict({
                    "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
                    "rows": pa.array([n if i == j == 0 else 0], pa.int64()),
                    "s": pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()),
                                                  pa.array(part))})
    return run


def _add_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted tiles of one place after another to their sum."""
    held: dict[tuple[int, int], list] = {}

    def out():
        (i, j), (n, v) = held.popitem()
        return pa.RecordBatch.from_pydict({
            "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
            "rows": pa.array([n], pa.int64()),
            "s": pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))})

    for b in batches:
        values, at = b.column("s").values.to_numpy(), b.column("s").offsets.to_numpy()
        for k, (i, j, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("i", "j", "rows")),
                                          strict=True)):
            v = values[at[k]:at[k + 1]]
            if held and (i, j) not in held:
                yield out()
            if (i, j) in held:
                held[i, j][0] += n
                held[i, j][1] += v
            else:
                held[i, j] = [n, v.copy()]
    if held:
        yield out()


def _rows(df: DataFrame, label: str | Column, weight: str | Column | None) -> DataFrame:
    y = (F.col(label) if isinstance(label, str) else label).cast("double")
    w = F.lit(1.0) if weight is None else (
        F.col(weight) if isinstance(weight, str) else weight).cast("double")
    return df.select(vector_to_array("features").alias("x"), y.alias("y"), w.alias("w")).where(
        F.col("y").isNotNull() & (F.col("w") > 0))


def _sums(rows: DataFrame, p: int, working: Callable | None = None) -> Sums:
    parts = rows.mapInArrow(_tiles_kernel(p, working), TILES)
    tiles = (parts.repartition("i", "j").sortWithinPartitions("i", "j")
                  .mapInArrow(_add_kernel, TILES).collect())
    m, n = np.zeros((p + 2, p + 2)), 0
    for t in tiles:
        h, w = min(TILE, p + 2 - t["i"]), min(TILE, p + 2 - t["j"])
        part = np.array(t["s"]).reshape(h, w)
        m[t["i"]:t["i"] + h, t["j"]:t["j"] + w] = part
        m[t["j"]:t["j"] + w, t["i"]:t["i"] + h] = part.T
        n += t["rows"]
    return Sums(m, n)


def width(df: DataFrame) -> int:
    """Number of columns of the design; the first row tells."""
    row = df.select(F.size(vector_to_array("features")).alias("p")).first()
    p = int(row["p"]) if row else 0
    if p > MAX_COLUMNS:
        raise ValueError(f"{p} columns: the sums of products take at most {MAX_COLUMNS}; "
                         "use ridge_cv or logit_binomial")
    return p


def product_sums(df: DataFrame, label: str | Column = "share",
                 weight: str | Column | None = None) -> Sums:
    """Sums of products of a design (``features``), its label and weight."""
    ship_package(df.sparkSession)
    return _sums(_rows(df, label, weight), width(df))


def _solve(sums: Sums, penalty: float) -> tuple[float, np.ndarray]:
    """Minimise the weighted squares plus ``penalty`` times the squared coefficients."""
    m, p = sums.matrix, sums.columns
    total = m[0, 0]
    if total <= 0:
        return 0.0, np.zeros(p)
    mean = m[0, 1:] / total
    centred = m[1:, 1:] - total * np.outer(mean, mean)
    left = centred[:p, :p] + penalty * np.eye(p)
    coef = np.linalg.lstsq(left, centred[:p, p], rcond=None)[0] if p else np.zeros(0)
    return float(mean[p] - mean[:p] @ coef), coef


def ridge(sums: Sums, penalty: float) -> Fit:
    """M7 for a given penalty."""
    intercept, coef = _solve(sums, penalty)
    return Fit(intercept, coef, penalty)


def ridge_loo(df: DataFrame, penalties: list[float], label: str = "share",
              weight: str | None = None) -> Fit:
    """M7: the penalty with the least leave-one-out error, ties to the first.

    Leaving a row out changes its residual by ``1 / (1 - h)``, where ``h`` is the
    row's leverage under the fit of all rows; so each penalty needs one matrix,
    and all of them one pass.
    """
    rows, p = _rows(df, label, weight), width(df)
    ship_package(df.sparkSession)
    sums = _sums(rows, p)
    fits = [ridge(sums, a) for a in penalties]
    total = max(sums.matrix[0, 0], 1e-300)
    mean = sums.matrix[0, 1:1 + p] / total
    centred = sums.matrix[1:1 + p, 1:1 + p] - total * np.outer(mean, mean)
    inverses = [np.linalg.pinv(centred + a * np.eye(p)) for a in penalties]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(fits))
        for b in batches:
            x = _matrix(b.column("x"), p)
            y, w = b.column("y").to_numpy(), b.column("w").to_numpy()
            c = x - mean
            for k, (fit, inv) in enumerate(zip(fits, inverses, strict=True)):
                h = w * (1.0 / total + np.einsum("ij,jk,ik->i", c, inv, c))
                e = (y - fit.intercept - x @ fit.coef) / np.maximum(1.0 - h, 1e-12)
                out[k] += (w * e * e).sum()
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(fits)), pa.int32()),
                                          "e": pa.array(out)})
    errors = {r["k"]: r["e"] for r in rows.mapInArrow(run, "k int, e double")
              .groupBy("k").agg(F.sum("e").alias("e")).collect()}
    return fits[min(range(len(fits)), key=lambda k: (errors.get(k, 0.0), k))]


def probit(df: DataFrame, label: str = "share", trials: str = "n", penalty: float = 1e-3,
           steps: int = 50, tolerance: float = 1e-10) -> Fit:
    """M8 + O21: binomial regression with probit link, ``label`` weighted by ``trials``.

    Every step is one pass: sums of products with the weights and working
    responses that the current coefficients give each row.
    """
    rows, p = _rows(df, label, trials), width(df)
    ship_package(df.sparkSession)
    intercept, coef = 0.0, np.zeros(p)
    for _ in range(steps):
        def working(x, y, w, b0=intercept, b=coef):
            eta = np.clip(x @ b + b0, -8.0, 8.0)
            mu = np.clip(normal_cdf(eta), 1e-12, 1.0 - 1e-12)
            slope = np.exp(-eta * eta / 2.0) / math.sqrt(2.0 * math.pi)
            return eta + (y - mu) / slope, w * slope * slope / (mu * (1.0 - mu))
        new0, new = _solve(_sums(rows, p, working), penalty)
        moved = max(abs(new0 - intercept), float(np.abs(new - coef).max()) if p else 0.0)
        intercept, coef = new0, new
        if moved < tolerance:
            break
    return Fit(intercept, coef, penalty, "probit")


def coefficients(fit: Fit, names: list[str], df: DataFrame) -> DataFrame:
    """``feature_name, coef``, the intercept first."""
    rows = [("(intercept)", fit.intercept), *zip(names, map(float, fit.coef), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature_name string, coef double")


def split(df: DataFrame, key: str = "region", test_fraction: float = 0.1,
          seed: int = 0) -> DataFrame:
    """K5: ``df`` with ``part``: ``test`` for a share of the keys, by a hash of key and seed."""
    u = hash_uniform(F.concat_ws("\x1f", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("part", F.when(u < test_fraction, "test").otherwise("train"))
