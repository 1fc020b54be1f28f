"""Several featurizers over one scan of the rows (X2, X3, X4; sums for A6, A10-A14).

A featurizer is a *block*: it names the real and discrete columns it reads
and turns a chunk of encoded rows into weighted sums.  One Arrow kernel
evaluates all blocks: the columns any block reads are encoded once, each
block picks its own by a mask of column numbers, and the kernel keeps one
running vector per (block, region, subset).  A task hands on one row with an
*array* per vector, so the shuffle has tasks x regions x blocks rows however
many frequencies a block has; a second kernel adds the arrays while they
stream past.  The summed table is stored, and values and weights of every
embedding are read from it.

Frequencies are shipped to the executors up to ``MAX_FREQ_BYTES`` at a time.
A larger set is cut into tiles of columns, and each group of tiles that fits
is another scan.

Subsets are flags of a row, not copies of it: a row counts with weight 0
where its flag is off, so every subset of a region has a sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.operators.embed import subset_flags, weight_col
from regemb.operators.encode import standardize, with_ranks
from regemb.operators.stats import Stats
from regemb.session import ship_package, stored

MAX_FREQ_BYTES = 256 * 1024 * 1024
ROWS_PER_CHUNK = 2048
HELD_BYTES = 64 << 20        # running sums that a task holds before it hands them on


@dataclass
class Block:
    """What one featurizer reads, and the length of its vector.

    The vector is ``heads`` weights followed by ``size`` sums: one weight,
    or one per level for a block that is conditional on a level.
    """

    reals: list[str]
    discretes: list[str]
    size: int = 0
    heads: int = 1
    first: int = 0            # first frequency of a tile

    def evaluate(self, chunk: Chunk) -> None:
        raise NotImplementedError


@dataclass
class Linear(Block):
    """Weighted sums of the reals, then of each level's indicator."""

    sizes: list[int] = field(default_factory=list)

    def evaluate(self, chunk):
        z = chunk.reals(self)
        for seg, into in chunk.segments(self):
            w = chunk.weights[seg]
            into[:, 0] += w.sum(axis=0)
            into[:, 1:1 + z.shape[1]] += w.T @ z[seg]
            at = 1 + z.shape[1]
            for column, n in zip(chunk.discretes(self), self.sizes, strict=True):
                _count(into[:, at:at + n], column[seg], w)
                at += n


@dataclass
class Fourier(Block):
    """Sums of sines, then cosines, of the angles.

    ``gathered`` tells for each discrete feature the row of ``freqs`` that its
    rank 0 stands for; ranks without a row of their own (-1 in ``rows``)
    add nothing.
    """

    freqs: np.ndarray | None = None
    rows: list[np.ndarray] = field(default_factory=list)

    def waves(self, chunk) -> np.ndarray:
        w = chunk.frequencies(self)
        if self.discretes:
            return self._waves(chunk, w)
        key = (id(w), *self.reals)          # blocks of one draw share their waves
        if key not in chunk.waves:
            chunk.waves[key] = self._waves(chunk, w)
        return chunk.waves[key]

    def _waves(self, chunk, w: np.ndarray) -> np.ndarray:
        z = chunk.reals(self)
        angles = z @ w[:z.shape[1]] if z.shape[1] else np.zeros((chunk.n, w.shape[1]))
        for ranks, row_of in zip(chunk.discretes(self), self.rows, strict=True):
            at = np.where(ranks >= 0, row_of[ranks], -1) if len(row_of) else ranks * 0 - 1
            on = at >= 0
            if on.all():
                angles += w[at]
            elif on.any():
                angles[on] += w[at[on]]
        return np.concatenate([np.sin(angles), np.cos(angles)], axis=1)

    def evaluate(self, chunk):
        waves = self.waves(chunk)
        for seg, into in chunk.segments(self):
            w = chunk.weights[seg]
            into[:, 0] += w.sum(axis=0)
            into[:, 1:] += w.T @ waves[seg]


@dataclass
class Conditional(Fourier):
    """Sums of waves per level of ``condition`` (A13), by wave, then level."""

    condition: str = ""

    def evaluate(self, chunk):
        waves = self.waves(chunk)
        ranks = chunk.ranks[self.condition]
        for seg, into in chunk.segments(self):
            w, level = chunk.weights[seg], ranks[seg]
            _count(into[:, :self.heads], level, w)
            body = into[:, self.heads:].reshape(len(into), -1, self.heads)
            order = np.argsort(level, kind="stable")
            order = order[level[order] >= 0]
            if not len(order):
                continue
            starts = np.flatnonzero(np.r_[True, np.diff(level[order]) != 0])
            for s in range(w.shape[1]):
                sums = np.add.reduceat(waves[seg][order] * w[order, s:s + 1], starts, axis=0)
                body[s][:, level[order][starts]] += sums.T


@dataclass
class LevelPairs(Block):
    """Weight of every pair of levels of two discrete features."""

    second: int = 0           # levels of the second feature

    def evaluate(self, chunk):
        a, b = chunk.discretes(self)
        at = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.second + b, -1)
        for seg, into in chunk.segments(self):
            w = chunk.weights[seg]
            into[:, 0] += w.sum(axis=0)
            _count(into[:, 1:], at[seg], w)


@dataclass
class Custom(Block):
    """A user's function of a chunk's reals and positions."""

    function: Callable | None = None
    offsets: list[int] = field(default_factory=list)

    def evaluate(self, chunk):
        ranks = [np.where(r >= 0, r + o, -1) for r, o in
                 zip(chunk.discretes(self), self.offsets, strict=True)]
        idx = np.stack(ranks, axis=1) if ranks else np.zeros((chunk.n, 0), np.int64)
        made = self.function(chunk.reals(self), idx)
        for seg, into in chunk.segments(self):
            w = chunk.weights[seg]
            into[:, 0] += w.sum(axis=0)
            into[:, 1:] += w.T @ made[seg]


def _count(into: np.ndarray, at: np.ndarray, w: np.ndarray) -> None:
    """Add each row's weights to column ``at`` (negative: none)."""
    on = at >= 0
    at, w = at[on], w[on]
    if len(at) * 8 < into.shape[1]:
        np.add.at(into.T, at, w)
    else:
        for s in range(w.shape[1]):
            into[s] += np.bincount(at, weights=w[:, s], minlength=into.shape[1])


class Chunk:
    """Encoded rows in region order, and the running vectors they add to."""

    def __init__(self, reals, ranks, weights, bounds, regions, held, frequencies):
        self.z, self.ranks, self.weights = reals, ranks, weights
        self.n = len(weights)
        self._bounds, self._regions = bounds, regions
        self._held, self._frequencies = held, frequencies
        self.number = 0
        self.waves: dict[tuple, np.ndarray] = {}

    def reals(self, block: Block) -> np.ndarray:
        return (np.stack([self.z[r] for r in block.reals], axis=1) if block.reals
                else np.zeros((self.n, 0)))

    def discretes(self, block: Block) -> list[np.ndarray]:
        return [self.ranks[d] for d in block.discretes]

    def frequencies(self, block: Block) -> np.ndarray:
        return self._frequencies[self.number]

    def segments(self, block: Block) -> Iterator[tuple[slice, np.ndarray]]:
        for (s, e), region in zip(self._bounds, self._regions, strict=True):
            key = (self.number, region)
            if key not in self._held:
                self._held[key] = np.zeros((self.weights.shape[1], block.heads + block.size))
            yield slice(s, e), self._held[key]


SUMS = "block int, region string, subset int, s array<double>"


def _vectors(rows: list[tuple]) -> pa.RecordBatch:
    """``(block, region, subset, vector)`` as a batch."""
    sizes = np.array([0] + [len(r[3]) for r in rows], np.int64)
    return pa.RecordBatch.from_pydict({
        "block": pa.array([r[0] for r in rows], pa.int32()),
        "region": pa.array([r[1] for r in rows], pa.string()),
        "subset": pa.array([r[2] for r in rows], pa.int32()),
        "s": pa.ListArray.from_arrays(
            np.cumsum(sizes).astype(np.int32),
            np.concatenate([r[3] for r in rows]) if rows else np.zeros(0))})


def _blocks_kernel(blocks: list[tuple[int, Block]], reals: list[str], discretes: list[str],
                   subsets: int, shipped, rows_per_chunk: int):
    held_limit = max(16, HELD_BYTES // (8 * subsets * sum(b.heads + b.size for _, b in blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies = dict(shipped.value)
        held: dict[tuple, np.ndarray] = {}

        def hand_on():
            rows = [(k, region, s, v) for (k, region), sums in held.items()
                    for s, v in enumerate(sums)]
            held.clear()
            # some vectors at a time: a list array counts its values in 31 bits
            for i in range(0, len(rows), 1024):
                yield _vectors(rows[i:i + 1024])

        for b in batches:
            if not b.num_rows:
                continue
            region = b.column("region").dictionary_encode()
            codes = region.indices.fill_null(len(region.dictionary)).to_numpy()
            names = [*region.dictionary.to_pylist(), None]
            order = np.argsort(codes, kind="stable")
            codes = codes[order]
            z = {r: b.column(f"z{i}").to_numpy()[order] for i, r in enumerate(reals)}
            ranks = {d: b.column(f"i{i}").to_numpy()[order] for i, d in enumerate(discretes)}
            w = b.column("w").to_numpy()
            weights = np.stack([np.where(b.column(f"s{i}").to_numpy(zero_copy_only=False), w, 0.0)
                                for i in range(subsets)], axis=1)[order]
            for s in range(0, len(codes), rows_per_chunk):
                e = min(s + rows_per_chunk, len(codes))
                c = codes[s:e]
                starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                bounds = list(zip(starts.tolist(), [*starts[1:].tolist(), e - s], strict=True))
                chunk = Chunk({k: v[s:e] for k, v in z.items()},
                              {k: v[s:e] for k, v in ranks.items()}, weights[s:e], bounds,
                              [names[i] for i in c[starts].tolist()], held, frequencies)
                for number, block in blocks:
                    chunk.number = number
                    block.evaluate(chunk)
            if len(held) > held_limit * len(blocks):
                yield from hand_on()
        yield from hand_on()
    return run


def _add_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted vectors of one key after another to their sum."""
    key, total, out = None, None, []
    for b in batches:
        values = b.column("s").values.to_numpy()
        bounds = b.column("s").offsets.to_numpy()
        keys = zip(b.column("block").to_pylist(), b.column("region").to_pylist(),
                   b.column("subset").to_pylist(), strict=True)
        for i, k in enumerate(keys):
            v = values[bounds[i]:bounds[i + 1]]
            if total is not None and k == key:
                total += v
                continue
            if total is not None:
                out.append((*key, total))
            key, total = k, v.copy()
            if len(out) >= 256:
                yield _vectors(out)
                out = []
    if total is not None:
        out.append((*key, total))
    yield _vectors(out)


def add_vectors(parts: DataFrame) -> DataFrame:
    """Sum of the arrays of each ``(block, region, subset)``; a key has a row per task at most."""
    key = ("block", "region", "subset")
    return (parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(_add_kernel, SUMS))


def _tiles(blocks: list[Block]) -> list[list[tuple[int, int, Block]]]:
    """Passes of ``(number, block of the caller, block)`` whose frequencies fit together."""
    passes: list[list] = [[]]
    room, number = MAX_FREQ_BYTES, 0
    shared: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parts = [b]
        if isinstance(b, Fourier) and not isinstance(b, Conditional):
            height, width = b.freqs.shape
            most = max(1, MAX_FREQ_BYTES // max(1, 8 * height))
            parts = [replace(b, freqs=b.freqs[:, k:k + most], first=b.first + k,
                             size=2 * min(most, width - k)) for k in range(0, width, most)]
        for p in parts:
            cost = 0
            if isinstance(p, Fourier):
                cost = 0 if id(p.freqs) in shared else p.freqs.nbytes
            if cost > room and passes[-1]:
                passes.append([])
                room, shared = MAX_FREQ_BYTES, {}
                cost = p.freqs.nbytes
            if isinstance(p, Fourier):
                shared[id(p.freqs)] = number
            room -= cost
            passes[-1].append((number, i, p))
            number += 1
    return passes


@dataclass
class Sums:
    """The stored sums and what is needed to read embeddings from them."""

    table: DataFrame
    blocks: list[tuple[int, int, Block]]      # number in the table, the caller's, block

    def weights(self, block: int) -> DataFrame:
        """``region, subset, weight`` of a block that is not conditional."""
        number = next(n for n, i, _ in self.blocks if i == block)
        return self.table.where(F.col("block") == number).select(
            "region", "subset", F.col("s")[0].alias("weight"))

    def level_weights(self, block: int) -> DataFrame:
        """``region, subset, rank, weight`` of a conditional block."""
        number, b = next((n, b) for n, i, b in self.blocks if i == block)
        return self.table.where(F.col("block") == number).select(
            "region", "subset", F.posexplode(F.slice("s", 1, b.heads)).alias("rank", "weight"))

    def values(self, block: int, scale: float = 1.0) -> DataFrame:
        """``region, subset, pos, value``: sums over their weight times ``scale``, 0 where it is 0."""
        out = None
        for number, i, b in self.blocks:
            if i != block:
                continue
            rows = self.table.where(F.col("block") == number).select(
                "region", "subset", "s",
                F.posexplode(F.slice("s", b.heads + 1, max(b.size, 1))).alias("k", "sum"))
            if not b.size:
                rows = rows.limit(0)
            weight = F.col("s")[(F.col("k") % b.heads).cast("int")]
            rows = rows.select("region", "subset", self._position(block, b).alias("pos"),
                               F.coalesce(F.try_divide(F.col("sum"), weight * F.lit(float(scale))),
                                          F.lit(0.0)).alias("value"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _position(self, block: int, b: Block) -> Column:
        k = F.col("k").cast("int")
        if isinstance(b, Fourier) and not isinstance(b, Conditional):
            width = sum(x.size for _, i, x in self.blocks if i == block) // 2
            half = b.size // 2
            return F.when(k < half, k + b.first).otherwise(k - half + width + b.first).cast("int")
        return k


def encoded_rows(df: DataFrame, stats: Stats, reals: list[str], discretes: list[str],
                 region_col: str, subsets, weight: str) -> DataFrame:
    """``region, w, s0.., z0.., i0..``: flags of subsets, reals, ranks (-1 for none)."""
    params = stats.real_params()
    ranked = with_ranks(df, stats, {d: f"__i{k}" for k, d in enumerate(discretes)})
    return ranked.select(
        F.col(region_col).cast("string").alias("region"), weight_col(weight).alias("w"),
        *[f.alias(f"s{i}") for i, f in enumerate(subset_flags(subsets))],
        *[standardize(F.col(r), *params.get(r, (None, None))).alias(f"z{i}")
          for i, r in enumerate(reals)],
        *[F.coalesce(F.col(f"__i{k}"), F.lit(-1)).alias(f"i{k}") for k in range(len(discretes))])


def block_sums(df: DataFrame, stats: Stats, blocks: list[Block], region_col: str = "region",
               subsets: list[str | Column] | None = None, weight: str | None = None,
               rows_per_chunk: int = ROWS_PER_CHUNK) -> Sums:
    """All blocks over the rows of ``df``: one scan for each set of frequencies that fits."""
    spark = df.sparkSession
    ship_package(spark)
    n_subsets = len(subsets or [0])
    parts, numbered = None, []
    for group in _tiles(blocks):
        of = [b for _, _, b in group]
        reals = list(dict.fromkeys(r for b in of for r in b.reals))
        discretes = list(dict.fromkeys(
            [d for b in of for d in b.discretes]
            + [b.condition for b in of if isinstance(b, Conditional)]))
        shipped = spark.sparkContext.broadcast(
            {n: b.freqs for n, _, b in group if isinstance(b, Fourier)})
        light = [(n, replace(b, freqs=None) if isinstance(b, Fourier) else b) for n, _, b in group]
        rows = encoded_rows(df, stats, reals, discretes, region_col, subsets,
                            weight or stats.spec.weight)
        made = rows.mapInArrow(_blocks_kernel(light, reals, discretes, n_subsets, shipped,
                                              rows_per_chunk), SUMS)
        parts = made if parts is None else parts.unionByName(made)
        numbered += [(n, i, replace(b, freqs=None) if isinstance(b, Fourier) else b)
                     for n, i, b in group]
    return Sums(stored(add_vectors(parts), "sums"), numbered)


# ----------------------------------------------------------------- blocks of a spec

def linear_block(stats: Stats, skip: set[str]) -> Linear:
    reals = [r for r in stats.spec.real if r not in skip]
    disc = [d for d in stats.spec.discrete_all if d not in skip]
    sizes = [stats.sizes()[d] for d in disc]
    return Linear(reals, disc, size=len(reals) + sum(sizes), sizes=sizes)


def fourier_block(stats: Stats, freqs: np.ndarray, skip: set[str],
                  ordered: dict[str, list[str]] | None = None) -> Fourier:
    """All encoded columns.  ``freqs`` has a row per catalogue position.

    A feature of ``ordered`` is thermometer coded (F3): level k switches on
    the columns of levels 1..k, so it gathers the prefix sum of their rows.
    """
    reals = [r for r in stats.spec.real if r not in skip]
    disc = [d for d in stats.spec.discrete_all if d not in skip]
    sizes, at, rows, extra = stats.sizes(), len(reals), [], []
    for d in disc:
        n = sizes[d]
        row_of = np.arange(at, at + n)
        if ordered and d in ordered:
            rank = {r["level"]: int(r["rank"]) for r in stats.dictionary().where(
                (F.col("feature") == d) & F.col("level").isin(ordered[d])).collect()}
            row_of = np.full(n, -1)
            total = np.zeros(freqs.shape[1])
            for level in ordered[d]:
                if level in rank:
                    total = total + freqs[at + rank[level]]
                    row_of[rank[level]] = len(freqs) + len(extra)
                    extra.append(total)
        rows.append(row_of)
        at += n
    if extra:
        freqs = np.vstack([freqs, np.array(extra)])
    freqs = np.ascontiguousarray(freqs, dtype=np.float64)
    return Fourier(reals, disc, size=2 * freqs.shape[1], freqs=freqs, rows=rows)


def real_block(reals: list[str], freqs: np.ndarray) -> Fourier:
    freqs = np.ascontiguousarray(freqs, dtype=np.float64)
    return Fourier(list(reals), [], size=2 * freqs.shape[1], freqs=freqs)


def conditional_block(stats: Stats, reals: list[str], freqs: np.ndarray,
                      condition: str) -> Conditional:
    freqs = np.ascontiguousarray(freqs, dtype=np.float64)
    n = stats.sizes()[condition]
    return Conditional(list(reals), [], size=2 * freqs.shape[1] * n, heads=n, freqs=freqs,
                       condition=condition)


def pair_block(stats: Stats, d1: str, d2: str) -> LevelPairs:
    sizes = stats.sizes()
    return LevelPairs([], [d1, d2], size=sizes[d1] * sizes[d2], second=sizes[d2])
