"""Exact dedup over an extendible-hash index on shared files (operator 6).

Two texts are copies when they are identical after deleting every character
of ``[\\x20\\x09-\\x0D]``.  The index holds one lean entry per document (64-bit
hash of the normalised text, id, code points, digest), never the text itself:

1. **Directory.**  One aggregation counts entries per hash prefix.  The
   directory starts with one bucket and doubles while some bucket holds more
   *distinct* hashes than ``capacity``; only overfull buckets split, the rest
   keep their smaller local depth and are pointed to by several directory
   slots.  Copies share a hash and can never be split, so they do not count:
   they are chained instead.
2. **Bucket files.**  Entries are written to the shared folder, laid out by
   bucket.  Writing is dealt by (bucket, salt), so a bucket that holds a third
   of all rows is written by several tasks.
3. **Owner tasks.**  Each owns a range of hashes (a bucket) and collects the
   chains: hashes with two entries or more.  The sums are combined before the
   shuffle, so a hot chain arrives as one row per task.
4. **Comparing bytes.**  Only documents on chains are read again with their
   text.  They are grouped by (hash, normalised text): the grouping compares
   the bytes, so colliding hashes stay apart, and a hot group is again
   combined before the shuffle.

Of equal texts the row with the most code points in the original text stays,
then the one with the smallest id (null ids come last).  Rows that repeat an id
and a text are one document: :func:`classes` counts each and marks each alike,
:func:`dedup` leaves one.
Null text counts as empty; empty texts are copies of each other.  An empty
table gives an empty result.  Other columns are ignored by :func:`classes` and
passed through by :func:`dedup`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.llm.base import stored, text_of

CAPACITY = 200_000   # distinct hashes in a bucket before it splits
MAX_DEPTH = 20       # directory of at most 2^20 slots; beyond it buckets just grow
SALTS = 16


def normalised(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def grow_directory(counts: Mapping[int, int], depth: int, capacity: int) -> list[tuple[int, int]]:
    """Slots of an extendible directory as ``(local depth, prefix)`` per slot.

    ``counts`` has the number of distinct hashes per ``depth``-bit prefix.
    The directory doubles (one more leading bit) as long as some bucket is
    overfull and bits are left.
    """
    def held(d: int, prefix: int) -> int:
        lo = prefix << (depth - d)
        return sum(counts.get(p, 0) for p in range(lo, lo + (1 << (depth - d))))

    slots: list[tuple[int, int]] = [(0, 0)]
    global_depth = 0
    while True:
        overfull = {b for b in set(slots) if b[0] < depth and held(*b) > capacity}
        if not overfull:
            return slots
        if any(d == global_depth for d, _ in overfull):
            slots = [b for b in slots for _ in (0, 1)]      # doubling
            global_depth += 1
        slots = [(d + 1, i >> (global_depth - d - 1)) if (d, p) in overfull else (d, p)
                 for i, (d, p) in enumerate(slots)]


class HashIndex:
    """The index: its directory and its bucket files in the shared folder."""

    def __init__(self, entries: DataFrame, capacity: int = CAPACITY):
        n = entries.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
        depth = min(MAX_DEPTH, max(0, (4 * n // max(1, capacity)).bit_length()))
        prefix = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0)
        counts = {}
        if depth:
            counts = {r["p"]: r["n"] for r in
                      entries.groupBy(prefix.alias("p"))
                      .agg(F.approx_count_distinct("key").alias("n")).collect()}
        self.slots = grow_directory(counts, depth, capacity)
        self.depth = (len(self.slots) - 1).bit_length()
        buckets = sorted(set(self.slots), key=lambda b: b[1] / (1 << b[0]))
        number = {b: i for i, b in enumerate(buckets)}
        self.directory = [number[b] for b in self.slots]
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        self.entries = stored(
            entries.withColumn("bucket", self.bucket_of(F.col("key")))
                   .repartition("bucket", salt).sortWithinPartitions("bucket", "key"),
            "dedup-buckets")

    def bucket_of(self, key: Column) -> Column:
        if self.depth == 0:
            return F.lit(0)
        slots = F.split(F.lit(",".join(map(str, self.directory))), ",").cast("array<int>")
        slot = F.shiftrightunsigned(key, 64 - self.depth).cast("int")
        return F.element_at(slots, slot + 1)

    def chains(self) -> DataFrame:
        """``(bucket, key)`` of every hash that two entries or more share."""
        return (self.entries.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("bucket", "key"))


def classes(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per document."""
    norm = normalised(F.col("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    entries = texts.select(
        "doc_id", F.xxhash64(norm).alias("key"),
        F.char_length("text").cast("long").alias("points"),
        F.sha2(norm.cast("binary"), 256).alias("sha"))
    index = HashIndex(entries, capacity)
    chains = stored(index.chains(), "dedup-chains")

    # documents on chains, with their bytes
    on_chain = (texts.select("doc_id", norm.alias("norm"), F.xxhash64(norm).alias("key"),
                             F.char_length("text").cast("long").alias("points"))
                     .join(chains.select("key"), "key", "left_semi"))
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"),
                          F.col("doc_id").alias("doc_id")))
    groups = stored(
        on_chain.groupBy("key", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
                .select("key", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
                        F.col("best.doc_id").alias("best_id"),
                        (-F.col("best.p")).alias("best_points"), "size"),
        "dedup-groups")
    # alone: entries whose hash nobody shares stay as they are
    return (index.entries.join(groups, ["key", "sha"], "left")
            .select("doc_id",
                    F.when(F.col("size").isNull(), F.col("doc_id"))
                     .otherwise(F.col("best_id")).alias("keep_id"),
                    F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("size").isNull() | (F.col("doc_id").eqNullSafe(F.col("best_id"))
                     & (F.col("points") == F.col("best_points")))).alias("kept"),
                    F.col("sha").alias("text_sha256")))


def dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows one."""
    norm = normalised(text_of())
    low = F.lit(-(1 << 63))
    # the columns of docs travel in one, so that none can clash with the key
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                       F.coalesce(F.col("doc_id").cast("long"), low).alias("__id"),
                       F.sha2(norm.cast("binary"), 256).alias("__sha"))
    kept = (classes(docs, capacity).where("kept")
            .select(F.coalesce("doc_id", low).alias("__id"),
                    F.col("text_sha256").alias("__sha")).distinct())
    return (mine.join(kept, ["__id", "__sha"], "left_semi")
                .dropDuplicates(["__id", "__sha"])
                .select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
