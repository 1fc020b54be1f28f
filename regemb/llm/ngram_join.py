"""N-gram Jaccard join with Bayesian pruning (operator 1).

Documents are near when the Jaccard of their sets of five-word shingles is 0.8
or more.

1. **Sets.**  Every document becomes a digest of its shingle set and ``HASHES``
   MinHash values.  Documents with equal sets are one *node* with a number of
   copies; the grouping is combined before its shuffle.
2. **Candidates.**  Nodes that agree on a band of ``ROWS`` values share a
   bucket.  Buckets of one member are dropped before signatures move.  A large
   bucket is cut into blocks of ``BLOCK`` members and each pair of blocks is a
   unit of work, so no task holds a whole hot bucket and no pair is a row.
3. **Bayesian pruning.**  Inside a unit, pairs are compared ``STEP`` MinHash
   values at a time.  With ``m`` of ``n`` values equal and a uniform prior, the
   probability that the Jaccard reaches the threshold is that of at most ``m``
   successes in ``n + 1`` draws of the threshold; a pair whose probability falls
   below ``TOLERANCE`` is dropped.  A pair is looked at only in the first band
   it shares.
4. **Exact check.**  Units with pairs left fetch the shingle sets of those
   members and compare them exactly.  A unit returns, per member, how many
   documents it links to and one edge of a spanning forest.
5. **Classes.**  Connected components of the forests; a class is named by its
   smallest document id.

What can be missed: a pair of Jaccard 0.8 shares no band with probability
``(1 - 0.8 ** ROWS) ** (HASHES / ROWS)`` (2.7e-5), or is pruned with about
``TOLERANCE``; both fall fast above the threshold.  Links among equal sets are
always counted.

Texts without words have equal (empty) sets and form one class of copies.
Null text counts as empty.  Null ids stay null and name a class only if it has
no other id.  Rows that repeat an id are separate documents.  An empty table
gives an empty result; extra columns are ignored by :func:`classes`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.llm.base import id_and_text, stored, text_of
from regemb.llm.shingles import SIZE, MinHasher, shingle_sets
from regemb.operators.graph import connected_components

THRESHOLD = 0.8
HASHES, ROWS, STEP = 80, 4, 16
TOLERANCE = 1e-4
BLOCK = 1024
TEXTS = 200          # texts hashed at once
PAIRS = 20_000       # pairs compared at once


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                   hashes: int = HASHES, step: int = STEP) -> list[tuple[int, int]]:
    """``(n, m)``: after n values, fewer than m matches drop the pair."""
    out = []
    for n in range(step, hashes + 1, step):
        below, m = 0.0, 0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
        out.append((n, m))
    return out


def survivors(sig: np.ndarray, x: np.ndarray, y: np.ndarray, band: np.ndarray,
              limits: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs ``(x, y)`` first meet in their ``band`` and stay likely."""
    keep = []
    for s in range(0, len(x), PAIRS):
        xi, yi = x[s:s + PAIRS], y[s:s + PAIRS]
        same = (sig[xi].reshape(len(xi), -1, ROWS) == sig[yi].reshape(len(xi), -1, ROWS)).all(2)
        alive = np.flatnonzero(same.argmax(1) == band[s:s + PAIRS])
        matches, before = np.zeros(len(alive), np.int64), 0
        for n, least in limits:
            matches += (sig[xi[alive], before:n] == sig[yi[alive], before:n]).sum(1)
            ok = matches >= least
            alive, matches, before = alive[ok], matches[ok], n
        keep.append(alive + s)
    return np.concatenate(keep) if keep else np.zeros(0, np.int64)


def _sets_kernel(batches: Iterator[pa.RecordBatch], with_sets: bool) -> Iterator[pa.RecordBatch]:
    hasher = MinHasher(HASHES)
    for b in batches:
        for s in range(0, b.num_rows, TEXTS):
            part = b.slice(s, TEXTS)
            sets = shingle_sets(part.column("text").to_pylist(), SIZE)
            digests = [hashlib.blake2b(v.tobytes(), digest_size=8).digest() for v in sets]
            node = np.frombuffer(b"".join(digests), "<i8")
            if with_sets:
                yield pa.RecordBatch.from_pydict({
                    "found": pa.array(node),
                    "node": part.column("node"),
                    "shingles": pa.array([v.tobytes() for v in sets], pa.binary())})
            else:
                sig = hasher.signatures(sets)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "sha": part.column("sha"),
                    "node": pa.array(node),
                    "n": pa.array([len(v) for v in sets], pa.int64()),
                    "sig": pa.array([r.tobytes() for r in sig], pa.binary())})


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _sets_kernel(batches, False)


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _sets_kernel(batches, True)


def _units(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Runs of whole units (rows sorted by bucket, i, j), of about ``rows`` rows."""
    rest: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        rest.append(b)
        held += b.num_rows
        if held < rows:
            continue
        t = pa.Table.from_batches(rest).combine_chunks()
        cut = _unit_starts(t)[-1]
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut).combine_chunks().to_batches()
        held = sum(r.num_rows for r in rest)
    if held:
        yield pa.Table.from_batches(rest).combine_chunks()


def _unit_starts(t: pa.Table) -> np.ndarray:
    k = np.column_stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")])
    return np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1])


def _pairs(t: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside each unit: within a block, or between two blocks."""
    own = t.column("block").to_numpy()
    i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
    xs, ys = [], []
    for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
        if i[lo] == j[lo]:
            a, b = np.triu_indices(hi - lo, 1)
        else:
            left, right = np.flatnonzero(own[lo:hi] == i[lo]), np.flatnonzero(own[lo:hi] == j[lo])
            a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        xs.append(a + lo)
        ys.append(b + lo)
    return np.concatenate(xs), np.concatenate(ys)


def _matrix(t: pa.Table, column: str, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), dtype).reshape(-1, width)


def _likely(t: pa.Table, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit starts and the pairs left after pruning."""
    starts = _unit_starts(t)
    sig = _matrix(t, "sig", "<u4", HASHES)
    x, y = _pairs(t, starts)
    alive = survivors(sig, x, y, t.column("band").to_numpy()[x], limits)
    return starts, x[alive], y[alive]


def _candidate_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a unit that have a likely partner in it."""
    limits = fewest_matches()
    for t in _units(batches, 4 * BLOCK):
        _, x, y = _likely(t, limits)
        hit = np.unique(np.concatenate([x, y]))
        yield from t.select(["bucket", "band", "i", "j", "block", "node", "copies", "sig"]) \
                    .take(hit).combine_chunks().to_batches()


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets."""
    members, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    if len(x) <= 4 * len(members):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                         for a, b in zip(x, y, strict=True)], np.int64)
    # many pairs among few members: products of the member-by-shingle matrix
    owner = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    values, column, count = np.unique(np.concatenate([sets[m] for m in members]),
                                      return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    use = count[column] > 1
    owner, column = owner[use], shared[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(members), len(members)), np.float32)
    width = 2048
    for lo in range(0, int(shared[-1]) + 1 if len(shared) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        if a < b:
            part = np.zeros((len(members), width), np.float32)
            part[owner[a:b], column[a:b] - lo] = 1.0
            both += part @ part.T
    return both[at[:len(x)], at[len(x):]].astype(np.int64)


def _verify_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per member of a unit: documents it links to there, and an edge of the forest."""
    limits = fewest_matches()
    for t in _units(batches, BLOCK):
        starts, x, y = _likely(t, limits)
        sets = [np.frombuffer(v, "<u8") for v in t.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        unit = np.searchsorted(starts, x, side="right")
        links = np.zeros(t.num_rows, np.int64)
        root = np.arange(t.num_rows)

        def find(a: int, root=root) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for u in np.unique(unit):
            of = np.flatnonzero(unit == u) if len(starts) > 1 else np.arange(len(x))
            a, b = x[of], y[of]
            both = overlaps(sets, a, b)
            near = both >= THRESHOLD * (size[a] + size[b] - both) - 1e-9
            a, b = a[near], b[near]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
        hit = np.flatnonzero(links)
        top = np.array([find(h) for h in hit.tolist()], np.int64)
        yield pa.RecordBatch.from_pydict({
            "node": pa.array(node[hit]), "links": pa.array(links[hit]),
            "root": pa.array(node[top])})


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links``: one row per document."""
    members, by_node = _joined(docs)
    return members.join(by_node, "node").select("doc_id", "class_id", "n_links")


def _text_sha() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, nodes)``: the node of every row, and the component, class and links of nodes."""
    texts = id_and_text(docs)
    members = stored(texts.withColumn("sha", _text_sha()).mapInArrow(
        _signatures, "doc_id long, sha binary, node long, n long, sig binary"), "ngram-members")
    nodes = stored(members.groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"),
        F.max("n").alias("n"), F.max("sig").alias("sig")), "ngram-nodes")

    bands = HASHES // ROWS
    per_band = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    lean = (nodes.where("n > 0").select("node", F.posexplode(per_band).alias("band", "bucket")))
    buckets = stored(lean.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"),
                     "ngram-buckets")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = (lean.join(buckets, "bucket")
              .withColumn("blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("node", "bucket", "band", "block", F.least("block", "other").alias("i"),
                      F.greatest("block", "other").alias("j")))
    units = (placed.join(nodes.select("node", "copies", "sig"), "node")
             .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"))
    member_schema = ("bucket long, band int, i int, j int, block int, node long, copies long, "
                     "sig binary")
    likely = stored(
        units.select("bucket", "band", "i", "j", "block", "node", "copies", "sig")
             .mapInArrow(_candidate_kernel, member_schema), "ngram-likely")

    wanted = (likely.select("node").distinct().join(nodes.select("node", "first_id"), "node")
              .withColumn("key", F.coalesce("first_id", F.lit(-(1 << 63)))).drop("first_id"))
    sets = (texts.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
            .join(wanted, "key").select("node", "text")
            .mapInArrow(_shingle_sets, "found long, node long, shingles binary")
            .where("found = node").dropDuplicates(["node"]).select("node", "shingles"))
    checked = stored(
        likely.join(sets, "node")
              .select("bucket", "band", "i", "j", "block", "node", "copies", "sig", "shingles")
              .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
              .mapInArrow(_verify_kernel, "node long, links long, root long"), "ngram-links")

    component = connected_components(checked.where("node != root"), "node", "root")
    named = (nodes.select("node", "copies", "first_id")
             .join(component, "node", "left")
             .join(checked.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    by_node = stored(named.join(smallest, "component").select(
        "node", "component", "class_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "ngram-classes")
    return members.select("doc_id", "sha", "node"), by_node


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each class stays, with all its columns.

    The row with the smallest id stays (null ids last), then the one whose
    text has the smallest SHA-256; of rows equal in both, one.
    """
    members, by_node = _joined(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")
    kept = (members.join(by_node.select("node", "component"), "node")
            .groupBy("component").agg(F.min(order).alias("first"))
            .select(F.col("first.doc_id").alias("__kept_id"), F.col("first.sha").alias("__kept_sha")))
    # the columns of docs travel in one, so that none can clash with the key
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                       F.col("doc_id").cast("long").alias("__id"),
                       text_of().alias("text")).withColumn("__sha", _text_sha()).drop("text")
    return (rows.join(kept, F.col("__id").eqNullSafe(F.col("__kept_id"))
                      & (F.col("__sha") == F.col("__kept_sha")), "left_semi")
                .dropDuplicates(["__id", "__sha"])
                .select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
