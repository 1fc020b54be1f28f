"""Conversation structure repair by least-cost edits (operator 11).

A conversation is well formed when its role initials read ``(s?(ua)+)?``: an
optional system turn, then user and assistant in turn, or nothing at all.  Its
rows, by turn, are walked through an *edit lattice*: a node is (rows read,
state of the pattern), an edge is an edit

====== ======================================================== ====
Keep   the row as it is                                            0
Rerole the row to user or assistant, whichever the pattern wants   2
Delete the row (the only edit for blank and duplicate rows)        3
Insert an empty user or assistant turn                             2
====== ======================================================== ====

and an undeleted truncated row costs one more.  The *audit* is the edits'
initials in order; of cheapest audits the ASCII-least is taken.  An audit fixes
the repaired rows, because every initial leads from a node to one node only.

1. **Rows to facts.**  A row becomes (conversation, turn, role, digest of the
   text, blank, truncated); equal rows are counted before they are shuffled.
   A row is a duplicate unless its turn is the first one that has its role and
   text; that minimum is an aggregate joined back, so one sentence that a
   third of all rows repeat is only a skewed join.
2. **Segments.**  Facts are dealt by range of (conversation, turn), so a very
   long conversation lies in several tasks.  Each task cuts what it has of a
   conversation into segments of :data:`SEGMENT` rows and searches each.
3. **Bidirectional Dijkstra.**  One heap runs from the start and one from the
   accepting nodes.  They stop when the sum of their least keys passes the
   best crossing, so every crossing of equal cost has been seen; the least
   concatenation of a forward and a backward audit wins.  A segment of a longer
   conversation is searched for each pair of entry and exit states, and the
   segments' answers are the edges of a smaller lattice that is searched the
   same way, :data:`FAN` segments at a time.
4. **Repaired rows.**  Texts are shuffled once, by conversation; the audit comes
   first in each conversation and is applied while the rows stream past.

No task holds the texts of a conversation.  The audit itself, a byte per row,
is one value by contract, as is the digest of all repaired lines, which is
computed as they stream.

Null role or text counts as one blank; null turns come first; a null id names
one conversation.  Rows of one turn are ordered by role, then by the SHA-256 of
their text; equal rows lie next to each other.  A role without a letter fits no
place of the pattern.  Conversations without rows have zeros, an empty audit
and the digest of the empty string.  Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.llm.base import stored

SEGMENT = 256            # rows that one search takes
FAN = 8                  # segments that one search joins
MEMORY = 200_000         # searched segments that a task remembers
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"

# States of the pattern: nothing yet, after s, after u, after a.
STATES = (0, 1, 2, 3)
ENDS = (0, 3)
INSERT_TO = {0: 2, 1: 2, 2: 3, 3: 2}
WANTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
INITIALS = {"s": 1, "u": 2, "a": 3}
KEEP_TO = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (3, 2): 2, (2, 3): 3}
LEGAL = {"su", "ua", "au"}
FORCED = 0               # code of a row that must go; others: initial (4: none) + 8 if truncated

Edges = dict[int, list[tuple[int, int, str]]]
Table = dict[tuple[int, int], tuple[int, str]]


# ----------------------------------------------------------------- rows

def damage(rows: DataFrame) -> DataFrame:
    """Rows with the faults that the checksum of ``conv_id:turn`` deals out.

    Columns ``conv_id, turn, role, text, copies``; a dropped row has no copies.
    """
    def blank(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.col("__kind")
    return (rows.select(
                F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                blank("role").alias("role"), blank("text").alias("text"),
                (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20)
                .alias("__kind"))
            .select("conv_id", "turn",
                    F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", ""))
                     .otherwise(F.col("text")).alias("text"),
                    F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("int").alias("copies")))


def as_rows(rows: DataFrame) -> DataFrame:
    """Any table of turns as ``conv_id, turn, role, text, copies``, a copy of each."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"),
                       F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
                       F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def facts(rows: DataFrame) -> DataFrame:
    """One row per distinct ``(conv_id, turn, role, text)`` without the text.

    ``fresh`` tells that no earlier turn of the conversation has this role and text.
    """
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    lean = stored(
        rows.select("conv_id", "turn", "role", _digest().alias("sha"), (end == "").alias("blank"),
                    (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"), "copies")
            .groupBy("conv_id", "turn", "role", "sha", "blank", "truncated")
            .agg(F.sum("copies").cast("long").alias("copies")), "turns")
    first = (lean.where("copies > 0").groupBy("conv_id", "role", "sha")
                 .agg(F.min(F.struct("turn")).alias("at"))
                 .select(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"),
                         F.col("sha").alias("f_sha"), F.col("at.turn").alias("f_turn")))
    return (lean.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv"))
                      & (F.col("role") == F.col("f_role")) & (F.col("sha") == F.col("f_sha")), "left")
                .withColumn("fresh", F.col("turn").eqNullSafe(F.col("f_turn")))
                .drop("f_conv", "f_role", "f_sha", "f_turn"))


# ----------------------------------------------------------------- the lattice

@lru_cache(maxsize=None)
def row_edges(code: int) -> Edges:
    """Edits of one row, by state."""
    edges: Edges = {q: [(q, DELETE, "D")] for q in STATES}
    if code != FORCED:
        extra, initial = (TRUNCATED if code & 8 else 0), code & 7
        for q in STATES:
            if (q, initial) in KEEP_TO:
                edges[q].append((KEEP_TO[q, initial], KEEP + extra, "K"))
            edges[q].append((INSERT_TO[q], REROLE + extra, "R"))
    return edges


def _turned(edges: Edges) -> Edges:
    back: Edges = {}
    for q, out in edges.items():
        for q2, cost, piece in out:
            back.setdefault(q2, []).append((q, cost, piece))
    return back


@lru_cache(maxsize=None)
def _row_edges_turned(code: int) -> Edges:
    return _turned(row_edges(code))


_INSERTS: Edges = {q: [(to, INSERT, "I")] for q, to in INSERT_TO.items()}
_INSERTS_TURNED = _turned(_INSERTS)


def search(steps: Sequence[Edges], back: Sequence[Edges], start: int, ends: Sequence[int],
           inserts: bool) -> tuple[int, str, int] | None:
    """Cheapest way from ``(0, start)`` to ``(len(steps), one of ends)``: cost, least audit, end.

    ``steps[i]`` are the edges from layer i to layer i + 1 and ``back`` the
    same edges turned round; with ``inserts`` a layer has its insert edges.
    Edges inside a layer cost something, so among nodes of one cost those of
    earlier layers (backwards: later layers) are final first and labels are
    settled with their least audit.  Two cheapest audits of one node are never
    each other's prefix, so the least concatenation is made of least parts.
    """
    n = len(steps)
    # side 0 runs forward, side 1 backward; labels are (cost, audit, end)
    labels: tuple[dict, dict] = ({(0, start): (0, "", -1)}, {(n, e): (0, "", e) for e in ends})
    settled: tuple[dict, dict] = ({}, {})
    heaps: tuple[list, list] = ([(0, 0, start)], [(0, 0, e) for e in ends])
    best: tuple[int, str, int] | None = None

    while heaps[0] or heaps[1]:
        tops = [h[0][0] if h else None for h in heaps]
        if best is not None and (None in tops or tops[0] + tops[1] > best[0]):
            break
        side = 0 if tops[1] is None or (tops[0] is not None and tops[0] <= tops[1]) else 1
        cost, depth, q = heappop(heaps[side])
        layer = depth if side == 0 else n - depth
        node = (layer, q)
        mine, other = settled[side], settled[1 - side]
        if node in mine:
            continue
        label = mine[node] = labels[side][node]
        audit, end = label[1], label[2]
        if node in other:
            c, a, e = other[node]
            found = (cost + c, audit + a if side == 0 else a + audit, max(end, e))
            if best is None or found < best:
                best = found
        for same_layer in (False, True):
            if same_layer:
                if not inserts:
                    break
                moves = (_INSERTS if side == 0 else _INSERTS_TURNED).get(q, ())
                layer2 = layer
            else:
                layer2 = layer + 1 if side == 0 else layer - 1
                if not 0 <= layer2 <= n:
                    continue
                moves = (steps[layer] if side == 0 else back[layer2]).get(q, ())
            for q2, step, piece in moves:
                key = (layer2, q2)
                if key in other:                       # a crossing
                    c, a, e = other[key]
                    found = (cost + step + c,
                             audit + piece + a if side == 0 else a + piece + audit, max(end, e))
                    if best is None or found < best:
                        best = found
                if key in mine:
                    continue
                new = (cost + step, audit + piece if side == 0 else piece + audit, end)
                if key not in labels[side] or new < labels[side][key]:
                    labels[side][key] = new
                    heappush(heaps[side], (new[0], layer2 if side == 0 else n - layer2, q2))
    return best


def _search_rows(codes: bytes, start: int, ends: Sequence[int]) -> tuple[int, str, int] | None:
    return search([row_edges(c) for c in codes], [_row_edges_turned(c) for c in codes],
                  start, ends, True)


@lru_cache(maxsize=MEMORY)
def solve_whole(codes: bytes) -> str:
    """The answer of a conversation that is one segment, as a table in JSON."""
    cost, audit, end = _search_rows(codes, 0, ENDS)
    return json.dumps([[0, end, cost, audit]])


def solve_segment(codes: bytes) -> str:
    """Cheapest audits of a segment for every pair of entry and exit states, in JSON."""
    out = []
    for q in STATES:
        for e in STATES:
            found = _search_rows(codes, q, (e,))
            if found is not None:
                out.append([q, e, found[0], found[1]])
    return json.dumps(out)


def read_table(text: str) -> Table:
    return {(q, e): (cost, audit) for q, e, cost, audit in json.loads(text)}


def join_tables(tables: list[Table]) -> Table:
    """Tables of neighbouring segments as one, :data:`FAN` at a time."""
    while len(tables) > 1:
        joined = []
        for i in range(0, len(tables), FAN):
            part = tables[i:i + FAN]
            steps: list[Edges] = []
            for t in part:
                edges: Edges = {}
                for (q, e), (cost, audit) in t.items():
                    edges.setdefault(q, []).append((e, cost, audit))
                steps.append(edges)
            back = [_turned(s) for s in steps]
            table: Table = {}
            for q in STATES:
                for e in STATES:
                    found = search(steps, back, q, (e,), False)
                    if found is not None:
                        table[q, e] = found[:2]
            joined.append(table)
        tables = joined
    return tables[0]


def final_audit(table: Table) -> tuple[int, str]:
    return min(table[0, e] for e in ENDS if (0, e) in table)


# ----------------------------------------------------------------- kernels

SEGMENTS = ("conv_id long, part int, seg int, first_turn long, last_turn long, turns long, "
            "blank long, duplicate long, truncated long, illegal long, n_rows long, "
            "first_initial string, last_initial string, answers string")
FACTS = ("blank", "duplicate", "truncated", "illegal")


class _Piece:
    """What a task has seen of one segment."""

    def __init__(self):
        self.codes = bytearray()
        self.first_turn = self.last_turn = None
        self.first_initial = self.last_initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.n = 0

    def add(self, turn, initial, blank, truncated, fresh) -> None:
        if turn is not None:
            if self.last_turn is None:
                self.first_turn = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        if self.n:
            self.illegal += self.last_initial + initial not in LEGAL
        else:
            self.first_initial = initial
        self.last_initial = initial
        self.n += 1
        if blank:
            self.blank += 1
        elif not fresh:
            self.duplicate += 1
        elif truncated:
            self.truncated += 1
        self.codes.append(FORCED if blank or not fresh
                          else INITIALS.get(initial, 4) + (8 if truncated else 0))

    def row(self, conv_id, part, seg, whole) -> tuple:
        codes = bytes(self.codes)
        return (conv_id, part, seg, self.first_turn, self.last_turn, self.turns, self.blank,
                self.duplicate, self.truncated, self.illegal, self.n, self.first_initial,
                self.last_initial, solve_whole(codes) if whole else solve_segment(codes))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)],
        names=[n for n, _ in fields])


def _segments_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted facts to searched segments.

    Only the first and the last conversation of a task can go on in another
    one, so every other short conversation is searched as a whole.
    """
    out: list[tuple] = []
    piece, conv, seg, part, seen = _Piece(), None, 0, 0, 0
    for b in batches:
        for c, turn, initial, blank, truncated, fresh, copies, p in zip(
                *(b.column(n).to_pylist() for n in ("conv_id", "turn", "initial", "blank",
                                                    "truncated", "fresh", "copies", "part")),
                strict=True):
            if not seen or c != conv:
                if seen:
                    out.append(piece.row(conv, part, seg, seen > 1 and seg == 0))
                piece, conv, seg, part = _Piece(), c, 0, p
                seen += 1
            for i in range(copies):
                if piece.n == SEGMENT:
                    out.append(piece.row(conv, part, seg, False))
                    piece, seg = _Piece(), seg + 1
                piece.add(turn, initial, blank, truncated, fresh and i == 0)
        if len(out) >= 1000:
            yield _batch(out, SEGMENTS)
            out = []
    if seen:
        out.append(piece.row(conv, part, seg, False))
    yield _batch(out, SEGMENTS)


AUDITS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
          "cost long, audit string")


def _join_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation, in order, to its audit."""
    def rows():
        for b in batches:
            yield from b.to_pylist()

    out: list[tuple] = []
    for conv, pieces in groupby(rows(), key=lambda r: r["conv_id"]):
        tables, total = [], dict.fromkeys(FACTS, 0)
        turns, first, last, initial = 0, None, None, None
        for p in pieces:
            tables.append(read_table(p["answers"]))
            for k in FACTS:
                total[k] += p[k]
            if p["n_rows"]:
                if initial is not None:
                    total["illegal"] += initial + p["first_initial"] not in LEGAL
                initial = p["last_initial"]
            if p["turns"]:
                turns += p["turns"] - (last is not None and last == p["first_turn"])
                first = p["first_turn"] if first is None else first
                last = p["last_turn"]
        cost, audit = final_audit(join_tables(tables))
        gaps = 0 if first is None else last - first + 1 - turns
        out.append((conv, gaps, *total.values(), cost, audit))
        if len(out) >= 1000:
            yield _batch(out, AUDITS)
            out = []
    yield _batch(out, AUDITS)


def audits(rows: DataFrame) -> DataFrame:
    """Faults, cost and audit of every conversation of ``rows`` (see :func:`as_rows`)."""
    key = ("conv_id", "turn", "role", "sha")
    segments = (facts(rows).repartitionByRange(*key).sortWithinPartitions(*key)
                .select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "blank",
                        "truncated", "fresh", "copies", F.spark_partition_id().alias("part"))
                .mapInArrow(_segments_kernel, SEGMENTS))
    return (segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
            .mapInArrow(_join_kernel, AUDITS))


def apply_audit(audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows ``(turn, role, text)`` to repaired ``(turn, role, text, edit)``; deleted ones are left out."""
    state, at = 0, 0

    def inserted():
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            yield None, WANTED[state], "", "I"
            state, at = INSERT_TO[state], at + 1

    for turn, role, text in rows:
        yield from inserted()
        edit = audit[at]
        at += 1
        if edit == "K":
            yield turn, role, text, edit
            state = KEEP_TO[state, INITIALS[role[:1]]]
        elif edit == "R":
            yield turn, WANTED[state], text, edit
            state = INSERT_TO[state]
    yield from inserted()


def _conversations(batches: Iterator[pa.RecordBatch]):
    """``(header row, its rows as they stream)`` of every conversation of a task."""
    def rows():
        for b in batches:
            yield from zip(*(b.column(n).to_pylist() for n in (
                "conv_id", "kind", "turn", "role", "text", "copies", "facts")), strict=True)

    for _, group in groupby(rows(), key=lambda r: r[0]):
        header = next(group)
        yield header, ((turn, role, text) for _, _, turn, role, text, copies, _ in group
                       for _ in range(copies))


REPAIRED = "conv_id long, position long, turn long, role string, text string, edit string"


def _repaired_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for header, rows in _conversations(batches):
        for i, (turn, role, text, edit) in enumerate(apply_audit(header[4], rows)):
            out.append((header[0], i, turn, role, text, edit))
            if len(out) >= 1000:
                yield _batch(out, REPAIRED)
                out = []
    yield _batch(out, REPAIRED)


DIGESTS = AUDITS + ", repaired_sha256 string"


def _digest_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for header, rows in _conversations(batches):
        h, between = hashlib.sha256(), b""
        for _, role, text, _ in apply_audit(header[4], rows):
            h.update(between + f"{role}:{text}".encode())
            between = b"\n"
        out.append((header[0], *header[6], header[4], h.hexdigest()))
        if len(out) >= 1000:
            yield _batch(out, DIGESTS)
            out = []
    yield _batch(out, DIGESTS)


def _with_audits(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Rows by conversation, each led by its audit."""
    long = F.lit(None).cast("long")
    heads = audited.select(
        "conv_id", F.lit(0).alias("kind"), long.alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit(0).alias("copies"),
        F.array("gaps", *FACTS, "cost").alias("facts"), F.lit(None).cast("binary").alias("sha"))
    turns = rows.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies",
        F.lit(None).cast("array<long>").alias("facts"), _digest().alias("sha"))
    return (heads.unionByName(turns).repartition("conv_id")
            .sortWithinPartitions("conv_id", "kind", "turn", "role", "sha").drop("sha"))


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations, a row per turn that is there afterwards."""
    return _with_audits(rows, stored(audits(rows), "audits")).mapInArrow(_repaired_kernel, REPAIRED)


def digests(rows: DataFrame) -> DataFrame:
    """A row per conversation: faults, cost, audit and the digest of the repaired lines."""
    return _with_audits(rows, stored(audits(rows), "audits")).mapInArrow(_digest_kernel, DIGESTS)
