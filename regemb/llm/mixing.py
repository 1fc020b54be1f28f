"""Mixing sources to target weights by Sainte-Lague apportionment (operator 4).

* **Targets.**  Sources in code-point order (null last) weigh 5, 2, 1 and so
  on in turn and share all words.  A target stops at ``MOST`` times the
  source's own size; what is over is shared again by weight until no target is
  above.  That is a water level, found in closed form.
* **Blocks.**  The mix is made of blocks of ``BLOCK`` words, or of fewer where a
  source's target is under ``FINE`` such blocks.  Sources get whole
  numbers of blocks by highest quotients (target / 1, 3, 5, ..), and each
  source's blocks go to its shards the same way.  The award is computed from
  the quotient at which the last block falls, not block by block.
* **Selection.**  The documents of a shard form one stream of words in a seeded
  order, cut into blocks.  Every block is taken ``quota // blocks`` times and a
  seeded run of ``quota % blocks`` neighbouring blocks once more, so all but
  the two documents at the ends of the run are taken whole.

A shard holds about ``SHARD_DOCS`` documents of one source, so a source with a
third of all rows is many shards.  Planning sees one row per source, then one
row per shard of a source (at most ``MAX_SHARDS``); texts never leave their
stream.

Words are runs of ``[^\\x20\\x09-\\x0D]``; null text has none.  Documents
without words are taken zero times.  Null sources form one source, the last.
Repeated rows are separate documents; rows of one id and size are told apart
by their text.  The same table and seed give the same
mix in any layout.  An empty table gives an empty mix.  Extra columns are
carried by :func:`mix`, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regemb.llm.base import stored, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 16
FINE = 64                # blocks that the smallest target has at least, if it has the words
SHARD_DOCS = 1_000
MAX_SHARDS = 65_536
SEED = 20240229
WORD = r"[^\x20\x09-\x0D]+"
SPANS = "array<struct<first:bigint,words:bigint,times:bigint>>"


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """Shares of ``sum(sizes)`` by weight, none above ``most`` times its size."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    total, caps = sizes.sum(), most * sizes
    if total <= 0:
        return np.zeros(len(sizes))
    order = np.argsort(caps / weights, kind="stable")
    capped = np.concatenate([[0.0], np.cumsum(caps[order])[:-1]])
    open_weight = np.cumsum(weights[order][::-1])[::-1]
    level = (total - capped) / open_weight
    at = int(np.argmax(level <= (caps / weights)[order] * (1 + 1e-12)))
    return np.minimum(caps, weights * level[at])


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients weight / (2k + 1), at most ``caps`` each.

    The quotient of the last seat is found by bisection; seats of equal
    quotient go to the first in order.
    """
    weights, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    caps = np.where(weights > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(weights), np.int64)

    def awarded(quotient: float) -> np.ndarray:
        return np.minimum(caps, np.floor((weights / quotient + 1) / 2).astype(np.int64))

    lo, hi = weights[weights > 0].min() / (2.0 * caps.max() + 3), weights.max() * 1.5
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        if awarded(mid).sum() >= seats:
            lo = mid
        else:
            hi = mid
        if hi / lo < 1 + 1e-14:
            break
    out = awarded(hi)
    while out.sum() < seats:          # seats at the quotient itself
        quotient = np.where(out < caps, weights / (2 * out + 1), -1.0)
        top = quotient.max()
        tied = np.flatnonzero(quotient >= top * (1 - 1e-12))[:seats - int(out.sum())]
        out[tied] += 1
    return out


def _plan_sources(pdf: pd.DataFrame) -> pd.DataFrame:
    key = [(s is None, (s or "").encode("utf-8", "surrogatepass")) for s in pdf["__source"]]
    pdf = pdf.iloc[sorted(range(len(pdf)), key=key.__getitem__)].reset_index(drop=True)
    sizes = pdf["source_size"].to_numpy(np.int64)
    weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(pdf))])
    target = targets(sizes, weights)
    # one size of block for all sources, a word at least
    least = target[target > 0].min() if (target > 0).any() else 1.0
    block = int(np.clip(least // FINE, 1, BLOCK))
    quota = sainte_lague(target, round(int(sizes.sum()) / block), MOST * -(-sizes // block))
    shards = np.clip(-(-pdf["docs"].to_numpy(np.int64) // SHARD_DOCS), 1, MAX_SHARDS)
    return pd.DataFrame({"__source": pdf["__source"], "source_size": sizes, "target": target,
                         "quota": quota, "shards": shards, "block": block})


def _plan_shards(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("shard").reset_index(drop=True)
    sizes = pdf["shard_size"].to_numpy(np.int64)
    blocks = -(-sizes // int(pdf["block"].iloc[0]))
    quota = sainte_lague(sizes, int(pdf["quota"].iloc[0]), MOST * blocks)
    safe = np.maximum(blocks, 1)
    return pd.DataFrame({
        "__source": pdf["__source"], "shard": pdf["shard"], "shard_size": sizes,
        "blocks": blocks, "each": quota // safe, "once_more": quota % safe,
        "run_start": pdf["draw"].to_numpy(np.int64) % safe})


def _in_shard(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Rows with their source's plan and their shard."""
    s = sources.withColumnRenamed("__source", "__planned")
    return (rows.join(s, rows["__source"].eqNullSafe(s["__planned"])).drop("__planned")
            .withColumn("__draw", F.xxhash64("doc_id", "__size", "__content", F.lit(seed)))
            .withColumn("shard", F.pmod(F.xxhash64("__draw", F.lit(seed)), F.col("shards"))))


def _spans(rows: DataFrame, lean: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with doc_id, __source, __size) plus the plan and each row's spans of words."""
    totals = lean.groupBy("__source").agg(F.sum("__size").alias("source_size"),
                                          F.count(F.lit(1)).alias("docs"))
    sources = stored(
        totals.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(
            _plan_sources, "__source string, source_size long, target double, quota long, "
                           "shards long, block long"), "mix-sources")
    sizes = (_in_shard(lean, sources, seed).groupBy("__source", "quota", "block", "shard")
             .agg(F.sum("__size").alias("shard_size"))
             .withColumn("draw", F.abs(F.xxhash64("__source", "shard", F.lit(seed)) % (1 << 40))))
    shards = stored(
        sizes.groupBy("__source").applyInPandas(
            _plan_shards, "__source string, shard long, shard_size long, blocks long, each long, "
                          "once_more long, run_start long"), "mix-shards")
    stream = (Window.partitionBy("__source", "shard").orderBy("__draw", "doc_id", "__content")
              .rowsBetween(Window.unboundedPreceding, 0))
    placed = (_in_shard(rows, sources, seed)
              .withColumn("__end", F.sum("__size").over(stream))
              .withColumn("__start", F.col("__end") - F.col("__size")))
    p = shards.select(F.col("__source").alias("__s"), F.col("shard").alias("__n"),
                      *[c for c in shards.columns if c not in ("__source", "shard")])
    planned = placed.join(p, placed["__source"].eqNullSafe(p["__s"])
                          & (placed["shard"] == p["__n"])).drop("__s", "__n")

    def overlap(lo, hi):
        first = F.greatest(F.col("__start"), lo)
        return F.struct((first - F.col("__start")).alias("first"),
                        (F.least(F.col("__end"), hi) - first).alias("words"),
                        F.lit(1).cast("long").alias("times"))

    zero = F.lit(0).cast("long")
    run_end = F.col("run_start") + F.col("once_more")
    whole = F.struct(zero.alias("first"), F.col("__size").alias("words"),
                     F.col("each").alias("times"))
    parts = F.array(
        whole,
        overlap(F.col("run_start") * F.col("block"),
                F.least(run_end * F.col("block"), F.col("shard_size"))),
        overlap(zero, F.greatest(zero, (run_end - F.col("blocks")) * F.col("block"))))
    return planned.withColumn(
        "spans", F.filter(parts, lambda s: (s["words"] > 0) & (s["times"] > 0)).cast(SPANS))


def taken_words(spans):
    return F.aggregate(spans, F.lit(0).cast("long"),
                       lambda a, s: a + s["words"] * s["times"])


def plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, spans`` of every document."""
    lean = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                              F.col("source").cast("string").alias("__source"),
                              F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("__size"),
                              F.xxhash64(text_of()).alias("__content")),
                  "mix-sizes")
    return _spans(lean, lean, seed).select(
        "doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"),
        "source_size", "target", "spans")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed rows: one per time a document is taken, with the columns of ``docs``.

    A document that is taken in part holds the words of that part, one blank
    between them; ``n_chars``, if there, follows the text.
    """
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("source").cast("string").alias("__source"), size.alias("__size"),
                         F.xxhash64(text_of()).alias("__content"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    lean = stored(packed.select("doc_id", "__source", "__size", "__content"), "mix-sizes")
    times = F.flatten(F.transform("spans", lambda s: F.array_repeat(s, s["times"].cast("int"))))
    rows = _spans(packed, lean, seed).select("__row", "__size", F.explode(times).alias("__span"))
    words = F.filter(F.split(F.col("__row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    span = F.col("__span")
    text = F.when(span["words"] == F.col("__size"), F.col("__row.text")).otherwise(
        F.array_join(F.slice(words, (span["first"] + 1).cast("int"), span["words"].cast("int")),
                     " "))
    out = rows.withColumn("__text", text)
    return out.select(*[
        F.col("__text").alias(c) if c == "text"
        else F.char_length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
