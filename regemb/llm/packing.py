"""Packing documents into fixed windows, shortest pack first (operator 3).

1. **Pieces.**  Each document is encoded (plus a closing id) and cut into full
   windows and one rest.  A piece carries position, length and checksum; ids
   are not shuffled.  The pieces are stored once.
2. **Histogram.**  Counts per piece length, at most ``window`` rows, go to the
   driver.
3. **Shortest pack first.**  Lengths are placed longest first.  Each length
   goes to the open packing pattern with the most room that can take it, for
   as many copies as both allow; patterns and their counts are updated, no
   document is looked at.
4. **Join by rank.**  Pieces of one length are ranked; each slot of a pattern
   owns an interval of ranks, and the interval gives sequence and offset.  The
   rank is built from counts per (length, salt) and a row number inside; a
   frequent length has many salts, so a length that a third of all pieces
   share is spread over many tasks.  The
   slot table is bounded by the histogram and is broadcast.

Null text counts as empty: such a document is its closing id alone.  Repeated
rows are packed as often as they occur.  An empty table gives no pieces.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regemb.llm.base import id_and_text, stored

WINDOW = 2048
END_ID = 1
SALT_ROWS = 500          # pieces of one length that one task numbers, about
PIECES = ("doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of whole texts: the fast encoder, and the reference one where special strings occur."""

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(json_path)

    def encode(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array([*ids, END_ID], "<u4")


def _pieces_kernel(json_path: str, ranks_path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(json_path, ranks_path)
        row = 0
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(),
                                    strict=True):
                ids = encoder.encode(text)
                for s in range(0, len(ids), window):
                    part = ids[s:s + window]
                    out.append((doc_id, row, s, len(part), zlib.crc32(part.tobytes()), len(ids)))
                row += 1
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_pydict({
                n.split()[0]: pa.array(c, pa.int64())
                for n, c in zip(PIECES.split(", "), cols, strict=True)})
    return run


@dataclass
class Slot:
    """Ranks ``first .. first + count - 1`` of pieces of ``length`` in one place of a pattern."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


def shortest_pack_first(histogram: dict[int, int], window: int) -> list[tuple[int, list[int]]]:
    """Patterns as ``(times, lengths)``: longest lengths first, into the emptiest pack they fit."""
    open_packs: dict[int, list[list]] = {}      # room -> [times, lengths]
    rooms: list[int] = []                       # rooms in use, ascending
    import bisect

    def put(room: int, times: int, lengths: list[int]) -> None:
        if room not in open_packs:
            open_packs[room] = []
            bisect.insort(rooms, room)
        for p in open_packs[room]:
            if p[1] == lengths:
                p[0] += times
                return
        open_packs[room].append([times, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = rooms[-1] if rooms and rooms[-1] >= length else None
            if room is None:
                put(window - length, left, [length])
                break
            times, lengths = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
                rooms.remove(room)
            n = min(times, left)
            if times > n:
                put(room, times - n, lengths)
            put(room - length, n, [*lengths, length])
            left -= n
    return sorted((t, p) for packs in open_packs.values() for t, p in packs)


def slots_of(patterns: list[tuple[int, list[int]]]) -> list[Slot]:
    """Give every pattern its sequences and every place in it an interval of ranks."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for n in lengths:
            out.append(Slot(n, used.get(n, 0), times, sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return out


def pack(docs: DataFrame, json_path: str, ranks_path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    pieces = stored(
        id_and_text(docs).mapInArrow(_pieces_kernel(json_path, ranks_path, window), PIECES),
        "packing-pieces")
    histogram = {r["length"]: r["n"] for r in
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = slots_of(shortest_pack_first(histogram, window))
    schema = "length long, first long, count long, sequence long, offset long"
    slot_table = spark.createDataFrame(
        [(s.length, s.first, s.count, s.sequence, s.offset) for s in slots], schema)

    # salts by length: an array of `window` numbers, folded into one literal
    salts = F.split(F.lit(",".join(str(1 + histogram.get(n, 0) // SALT_ROWS)
                                   for n in range(1, window + 1))), ",").cast("array<int>")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "start"),
                                              F.element_at(salts, F.col("length").cast("int"))))
    before = (salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(
                  Window.partitionBy("length").orderBy("salt")
                  .rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "row", "ids_crc32")
    ranked = (salted.withColumn("inside", F.row_number().over(inside) - 1)
              .join(before, ["length", "salt"])
              .withColumn("rank", F.col("inside") + F.col("before")))
    return (ranked.join(F.broadcast(slot_table), "length")
            .where((F.col("rank") >= F.col("first"))
                   & (F.col("rank") < F.col("first") + F.col("count")))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                    (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
                    "offset"))
