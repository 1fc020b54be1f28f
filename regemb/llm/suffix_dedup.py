"""Repeated passages by suffix arrays (operator 9).

A byte goes when a 50-byte string that covers it also starts in a document
with a smaller id.  Texts are taken as UTF-8; strings are judged on the input.

1. **Keys.**  Each 50-byte string gets a key that depends on its bytes alone:
   the smallest hash among its 16-byte pieces.  Neighbouring strings of one key
   form a *fragment*, about one per 18 bytes.
2. **Keys of two documents.**  (key, document) pairs meet at the key's owner,
   which answers with the pairs whose key occurs in two documents or more.  A
   task that sees such a key twice by itself sends one probe for it, so a hot
   key arrives once per task.
3. **Suffix arrays.**  Fragments of those keys go to the key's owner.  Of equal
   fragments in one task only those of the smallest document go, the others are
   marked at once.  The owner sorts all suffixes of its fragments in two
   stages: suffixes smaller than their successor are sorted directly (on the
   first 56 bytes), the others are induced by one scan over the first-byte
   buckets, each in the order of its successor.  Neighbours in the array that
   share 50 bytes are one string; all but those of its smallest document are
   marked.
4. **Removal.**  Marks return to their documents and are merged.

The table is shuffled once by id; both joins read that shuffle.  Keys and
fragments travel packed by range of keys.  Long texts are worked through in
slices.  A key with more than ``GROUP_BYTES`` of
fragments at its owner (a common phrase in very many surroundings) is not
sorted there: its strings are grouped by their bytes in a step of their own,
spread over all tasks.

Null text counts as empty.  Null ids count as one id below all others; such
rows travel under a hash of their text (one of the 2^40 lowest numbers, which
no id may be), so they do not share one list of keys.  Rows that repeat an id
never count as smaller than each other and are told apart by a checksum of
their text.  Texts under 50 bytes keep all.  An empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regemb.llm.base import shuffle_partitions, text_of
from regemb.llm.shingles import mix

LENGTH = 50
GRAM = 16
SLICE = 1 << 18            # bytes worked on at once
GATHER = 8 << 20           # bytes after which a task sends its keys
FRAGMENTS = 60_000         # distinct fragments after which a task sends them
SORT_BYTES = 1 << 19       # bytes of fragments in one suffix array, about
MARKS = 100_000            # marks after which an owner sends them, by range of documents
GROUP_BYTES = 16 << 20     # of one key; beyond, its strings are grouped by a shuffle
STRING_SLICE = 2 << 20     # bytes of such a key's fragments worked on at once
STRING_BINS = 32           # ranges of strings for each range of keys
NO_ID = -(1 << 63)
ANON = 1 << 40             # rows without an id have one of the lowest, by a hash of their text
_MARK = np.dtype([("check", "<u4"), ("start", "<i8"), ("end", "<i8")])


# --- keys and fragments ------------------------------------------------------


def _words(data: np.ndarray, n: int, order: str) -> np.ndarray:
    """The 8-byte word at each of the first ``n`` places (``data`` has 8 bytes to spare)."""
    return np.ndarray((n,), f"{order}u8", data, strides=(1,))


def string_keys(data: np.ndarray) -> np.ndarray:
    """Key of the 50-byte string at every place of ``data``."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64)
    w = _words(np.concatenate([data, np.zeros(8, np.uint8)]), n, "<")
    h = mix(w[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ mix(w[8:]))[:n - GRAM + 1]
    width, grams = 1, LENGTH - GRAM + 1
    while 2 * width <= grams:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:len(h) - (grams - width)], h[grams - width:])


def fragments(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, piece, first, last)``: runs of places in a piece whose strings share a key."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    keys = string_keys(data)
    none = np.zeros(0, np.int64)
    if not len(keys):
        return np.zeros(0, np.uint64), none, none, none
    ends = np.cumsum([len(p) for p in pieces])
    starts = ends - [len(p) for p in pieces]
    piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])[:len(keys)]
    valid = np.arange(len(keys)) + LENGTH <= ends[piece]
    change = np.ones(len(keys) + 1, bool)
    change[1:-1] = (keys[1:] != keys[:-1]) | (piece[1:] != piece[:-1]) | (valid[1:] != valid[:-1])
    at = np.flatnonzero(change)
    first, last = at[:-1], at[1:] - 1
    ok = valid[first]
    first, last = first[ok], last[ok]
    p = piece[first]
    return keys[first], p, first - starts[p], last - starts[p]


def slices(texts: list[tuple], limit: int = SLICE) -> Iterator[list[tuple]]:
    """Groups of ``(tag, offset, bytes)`` of about ``limit`` bytes; long texts are cut with overlap."""
    group, held = [], 0
    for tag, raw in texts:
        for o in range(0, max(1, len(raw) - LENGTH + 1), limit):
            part = raw[o:o + limit + LENGTH - 1]
            group.append((tag, o, part))
            held += len(part)
            if held >= limit:
                yield group
                group, held = [], 0
    if group:
        yield group


# --- suffix sorting ----------------------------------------------------------


def _by_words(w: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places by the seven words from each on; a word is looked at only to break ties."""
    places = places[np.argsort(w[places], kind="stable")]
    tied = np.arange(len(places))
    group = np.concatenate([[0], np.cumsum(w[places][1:] != w[places][:-1])]) if len(places) \
        else np.zeros(0, np.int64)
    for o in range(8, 49, 8):
        again = np.zeros(len(tied), bool)
        again[1:] = group[1:] == group[:-1]
        again[:-1] |= again[1:]
        tied, group = tied[again], group[again]
        if not len(tied):
            break
        v = w[places[tied] + o]
        order = np.lexsort((v, group))
        places[tied], v = places[tied][order], v[order]
        group = np.concatenate([[0], np.cumsum((v[1:] != v[:-1]) | (group[1:] != group[:-1]))])
    return places


def two_stage_order(data: np.ndarray) -> np.ndarray:
    """Places of ``data`` by the first 56 bytes (or more) of their suffixes."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    # a suffix is smaller than its successor iff the first unequal neighbour pair rises
    rises = np.zeros(n, bool)
    differs = np.flatnonzero(data[1:] != data[:-1])
    if len(differs):
        up = data[differs] < data[differs + 1]
        k = np.searchsorted(differs, np.arange(n))
        inside = k < len(differs)
        rises[inside] = up[k[inside]]
    # stage one: sort those directly
    small = np.flatnonzero(rises)
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    w = _words(padded, n + 56, ">")
    direct = _by_words(w, small)
    # stage two: induce the rest, bucket by bucket
    first_byte = data[direct]
    cuts = np.searchsorted(first_byte, np.arange(257))
    rest = np.flatnonzero(~rises)
    after = np.append(data[1:], 0).astype(np.int64)
    after[-1] = -1
    heads = rest[after[rest] < data[rest]]           # successor lies in an earlier bucket
    by_byte = heads[np.argsort(data[heads], kind="stable")]
    head_cuts = np.searchsorted(data[by_byte], np.arange(257))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    order = np.empty(n, np.int64)
    filled = 0
    for c in range(256):
        level = by_byte[head_cuts[c]:head_cuts[c + 1]]
        if len(level):
            level = level[np.argsort(rank[level + 1], kind="stable")]
        while len(level):                            # runs of c: each in its successor's order
            order[filled:filled + len(level)] = level
            rank[level] = np.arange(filled, filled + len(level))
            filled += len(level)
            before = level[level > 0] - 1
            level = before[data[before] == c]
        own = direct[cuts[c]:cuts[c + 1]]
        order[filled:filled + len(own)] = own
        rank[own] = np.arange(filled, filled + len(own))
        filled += len(own)
    return order


def shared_prefix(data: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each place in ``order`` shares ``length`` bytes with the one before it."""
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    w = _words(padded, len(data) + length, "<")
    same = np.ones(len(order), bool)
    same[:1] = False
    for o in [*range(0, length - 7, 8), length - 8]:
        v = w[order + o]
        same[1:] &= v[1:] == v[:-1]
    return same


def repeated_places(frags: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(fragment, place)`` of the strings that also stand in a smaller document."""
    data = np.frombuffer(b"".join(frags), np.uint8)
    sizes = np.array([len(f) for f in frags])
    owner = np.repeat(np.arange(len(frags)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - starts[owner]
    order = two_stage_order(data)
    order = order[place[order] + LENGTH <= sizes[owner[order]]]
    group = np.flatnonzero(~shared_prefix(data, order))
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = docs[owner[order]]
    least = np.repeat(np.minimum.reduceat(d, group), np.diff(np.append(group, len(order))))
    hit = np.sort(order[d > least])
    return owner[hit], place[hit]


def runs(owner: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(owner, first, last)`` of runs of neighbouring places (both sorted)."""
    if len(owner):
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)) + 1
        lo, hi = np.append(0, cut), np.append(cut, len(owner)) - 1
        yield from zip(owner[lo].tolist(), place[lo].tolist(), place[hi].tolist(), strict=True)


# --- kernels -----------------------------------------------------------------


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _spread(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64))


def _bin(keys: np.ndarray, bins: int) -> np.ndarray:
    """Equal ranges of 64-bit keys."""
    return ((keys >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int32)


def _key_bin(keys: np.ndarray, bins: int) -> np.ndarray:
    """Ranges of keys that hold about as many fragments each.

    A key is the smallest hash of ``w`` pieces, so low keys are frequent.  With
    ``q`` the chance that a hash is above a key, ``(w+1)/2 (1 - q^w) -
    (w-1)/2 (1 - q^(w+1))`` of all fragments have a smaller key.  Powers are
    taken by products, which give the same bits on every machine.
    """
    w = LENGTH - GRAM + 1
    q = 1.0 - (keys >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    power, square, left = np.ones_like(q), q, w
    while left:
        if left & 1:
            power = power * square
        square, left = square * square, left >> 1
    share = (w + 1) / 2 * (1.0 - power) - (w - 1) / 2 * (1.0 - power * q)
    return np.clip((share * bins).astype(np.int64), 0, bins - 1).astype(np.int32)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as compressed byte planes."""
    out = [np.array([len(columns)], "<i8").tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c)
        out.append(np.array([c.itemsize, len(c)], "<i8").tobytes())
        out.append(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8
    for _ in range(int(np.frombuffer(raw, "<i8", 1)[0])):
        width, n = np.frombuffer(raw, "<i8", 2, at).tolist()
        at += 16
        planes = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}"))
        at += width * n
    return out


def _pack_pairs(keys: np.ndarray, docs: np.ndarray) -> bytes:
    """(key, document) pairs, sorted by key."""
    ids, which = np.unique(docs, return_inverse=True)
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    return _pack(ids.view(np.uint64), which.astype(np.uint32), steps)


def _unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, which, steps = _unpack(blob)
    return np.cumsum(steps, dtype=np.uint64), ids.view(np.int64)[which]


def _key_kernel(bins: int):
    """Probes by range of keys and proved pairs by document: ``bin, proved, pairs``."""
    def send(keys: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
        k, d = np.concatenate(keys), np.concatenate(docs)
        o = np.lexsort((d, k))
        k, d = k[o], d[o]
        new_key = np.append(True, k[1:] != k[:-1])[:len(k)]
        new = new_key | np.append(True, d[1:] != d[:-1])[:len(k)]
        k, d, new_key = k[new], d[new], new_key[new]
        at = np.flatnonzero(new_key)
        size = np.diff(np.append(at, len(k)))
        shared = np.repeat(size > 1, size)
        rows = []
        for proved, kk, dd, b in (
                (0, k[at], d[at], _key_bin(k[at], bins)),
                (1, k[shared], d[shared], _bin(_spread(d[shared]), bins))):
            if not len(kk):
                continue
            o = np.argsort(b, kind="stable")
            b, kk, dd = b[o], kk[o], dd[o]
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            for lo, hi in zip(cut, np.append(cut[1:], len(b)), strict=True):
                rows.append((int(b[lo]), proved, _pack_pairs(kk[lo:hi], dd[lo:hi])))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_pydict({
            "bin": pa.array(cols[0], pa.int32()), "proved": pa.array(cols[1], pa.int32()),
            "pairs": pa.array(cols[2], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        held = 0
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for group in slices(list(enumerate(_texts(b)))):
                key, piece, _, _ = fragments([p for _, _, p in group])
                tags = np.array([t for t, _, _ in group])
                keys.append(key)
                docs.append(ids[tags[piece]])
                held += sum(len(p) for _, _, p in group)
                if held >= GATHER:
                    yield send(keys, docs)
                    keys, docs, held = [], [], 0
        if keys:
            yield send(keys, docs)
    return run


def _groups(batches: Iterator[pa.RecordBatch], column: str,
            limit: int | None) -> Iterator[tuple[bool, pa.Table]]:
    """``(giant, rows)``: whole groups of the sorted column; groups over ``limit`` bytes in parts."""
    def split(t: pa.Table) -> Iterator[tuple[bool, pa.Table]]:
        if limit is None:
            yield False, t
            return
        v = t.column(column).to_numpy()
        at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        held = np.add.reduceat(pc.binary_length(t.column("bytes")).to_numpy().astype(np.int64), at)
        giant = np.repeat(held > limit, np.diff(np.append(at, len(v))))
        if not giant.all():
            yield False, t.filter(pa.array(~giant)) if giant.any() else t
        if giant.any():
            yield True, t.filter(pa.array(giant))

    rest: list[pa.RecordBatch] = []
    size, giant = 0, None
    for b in batches:
        if giant is not None and b.num_rows:
            v = b.column(column).to_numpy()
            n = int(np.searchsorted(v != giant, True))
            if n:
                yield True, pa.Table.from_batches([b.slice(0, n)])
            b, giant = b.slice(n), giant if n == b.num_rows else None
        if not b.num_rows:
            continue
        v = b.column(column).to_numpy()
        cut = int(np.flatnonzero(v != v[-1])[-1]) + 1 if v[0] != v[-1] else 0
        if rest and rest[-1].column(column)[-1].as_py() != v[-1]:
            yield from split(pa.Table.from_batches([*rest, b.slice(0, cut)]))
            rest, size = [], 0
        elif cut:
            yield from split(pa.Table.from_batches([b.slice(0, cut)]))
        rest.append(b.slice(cut))
        if limit is not None:
            size += int(pc.sum(pc.binary_length(rest[-1].column("bytes"))).as_py() or 0)
            if size > limit:
                yield True, pa.Table.from_batches(rest)
                rest, size, giant = [], 0, v[-1]
    if rest:
        yield from split(pa.Table.from_batches(rest))


def _answer_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose key occurs in two documents: ``doc_id, key`` (rows sorted by proved, bin)."""
    def answer(held: list[bytes]) -> pa.RecordBatch:
        pairs = [_unpack_pairs(v) for v in held]
        k, d = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        o = np.argsort(k, kind="stable")
        k, d = k[o], d[o]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1])[:len(k)])
        size = np.diff(np.append(at, len(k)))
        two = np.repeat(np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at), size) \
            if len(at) else np.zeros(0, bool)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(d[two]),
                                           "key": pa.array(k[two].view(np.int64))})

    held: list[bytes] = []
    now = None
    for b in batches:
        for bin_, proved, blob in zip(*(b.column(c).to_pylist() for c in ("bin", "proved", "pairs")),
                                      strict=True):
            if proved:
                k, d = _unpack_pairs(blob)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d),
                                                  "key": pa.array(k.view(np.int64))})
                continue
            if bin_ != now and held:
                yield answer(held)
                held = []
            now = bin_
            held.append(blob)
    if held:
        yield answer(held)


_FRAGMENT = pa.schema([("marked", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()),
                       ("check", pa.int64()), ("places", pa.binary()), ("bytes", pa.binary())])
_FRAGMENT_DDL = ("marked int, key long, doc_id long, check long, places binary, bytes binary")


def _fragment_kernel(bins: int):
    """Fragments to compare (``places``: where they start), and marks that need no comparing.

    Packed by range of keys (marks by document) as ``bin, marked, rows``.
    """
    def send(rows: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
        if not rows:
            return
        route, marked, key, doc, check, places, part = zip(*rows, strict=True)
        r, m = np.array(route, np.int64).view(np.uint64), np.array(marked, np.int32)
        b = np.where(m == 1, _bin(r, bins), _key_bin(r, bins)) * 2 + m
        keys, docs, crcs = np.array(key, "<i8"), np.array(doc, "<i8"), np.array(check, "<u4")
        n_places = np.fromiter(map(len, places), "<u4", len(places))
        n_bytes = np.fromiter(map(len, part), "<u4", len(part))
        order = np.lexsort((keys, b))
        b = b[order]
        cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        for lo, hi in zip(cut, np.append(cut[1:], len(b)), strict=True):
            o = order[lo:hi].tolist()
            blob = _pack(
                keys[o], docs[o], crcs[o], n_places[o], n_bytes[o],
                np.frombuffer(b"".join(map(places.__getitem__, o)), "<i8"),
                np.frombuffer(b"".join(map(part.__getitem__, o)), np.uint8))
            yield int(b[lo]) // 2, int(b[lo]) % 2, blob

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            lists = b.column("keys")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            raw = _texts(b)
            checks = [zlib.crc32(r) for r in raw]
            id_list = ids.tolist()
            found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            for group in slices(list(enumerate(raw))):
                key, piece, first, last = fragments([p for _, _, p in group])
                key = key.view(np.int64)
                # which fragments' keys their row asked for: (row, key) by one number,
                # and a chance match only means one more fragment to compare
                rows = np.array([row for row, _, _ in group])
                asked = np.unique(rows)
                wanted = np.concatenate([values[offsets[r]:offsets[r + 1]] ^ _salt(r) for r in asked])
                use = np.flatnonzero(np.isin(key ^ _salt(rows[piece]), wanted))
                for k, g, s, e in zip(key[use].tolist(), piece[use].tolist(), first[use].tolist(),
                                      last[use].tolist(), strict=True):
                    row, offset, part = group[g]
                    where = (id_list[row], row, offset + s)
                    held = found.get((k, part[s:e + LENGTH]))
                    if held is None:
                        found[k, part[s:e + LENGTH]] = [where]
                    else:
                        held.append(where)
                if len(found) >= FRAGMENTS:
                    yield packed(found, ids, checks)
                    found = {}
            yield packed(found, ids, checks)

    def packed(found: dict, ids: np.ndarray, checks: list[int]) -> pa.RecordBatch:
        rows, marks = [], {}
        one = struct.Struct("<q").pack
        for (k, part), where in found.items():
            if len(where) == 1:
                d, row, place = where[0]
                rows.append((k, 0, k, d, checks[row], one(place), part))
                continue
            least = min(_rank_of(w[0]) for w in where)
            own: dict[int, list[int]] = {}
            for d, row, place in where:
                if _rank_of(d) == least:
                    own.setdefault(row, []).append(place)
                else:
                    marks.setdefault(row, []).append((place, place + len(part)))
            for row, places in own.items():
                rows.append((k, 0, k, int(ids[row]), checks[row],
                             np.array(places, "<i8").tobytes(), part))
        for row, spans in marks.items():
            d = int(ids[row])
            rows.append((int(_spread(np.array([d])).view(np.int64)[0]), 1, 0, d, checks[row],
                         merge(np.array(spans)).astype("<i8").tobytes(), b""))
        cols = list(zip(*send(rows), strict=True)) or [()] * 3
        return pa.RecordBatch.from_pydict({
            "bin": pa.array(cols[0], pa.int32()), "marked": pa.array(cols[1], pa.int32()),
            "rows": pa.array(cols[2], pa.binary())})
    return run


def _unfold_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed fragments as rows."""
    def binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [
            None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])

    for b in batches:
        for marked, blob in zip(b.column("marked").to_pylist(), b.column("rows").to_pylist(),
                                strict=True):
            key, doc, check, n_places, n_bytes, places, data = _unpack(blob)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(key), marked, np.int32)), pa.array(key.view(np.int64)),
                pa.array(doc.view(np.int64)), pa.array(check.astype(np.int64)),
                binary(n_places, places), binary(n_bytes, data)], schema=_FRAGMENT)


def _salt(rows) -> np.ndarray:
    return mix(np.asarray(rows, np.int64).view(np.uint64) + np.uint64(1)).view(np.int64)


def _rank(docs: np.ndarray) -> np.ndarray:
    """Documents as they compare: those without an id are one, below all others."""
    return np.where(docs < NO_ID + ANON, NO_ID, docs)


def _rank_of(doc: int) -> int:
    return NO_ID if doc < NO_ID + ANON else doc


def merge_marks(doc: np.ndarray, check: np.ndarray, start: np.ndarray, end: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of (document, checksum) as disjoint, not touching, sorted spans."""
    if not len(doc):
        return doc, check, start, end
    o = np.lexsort((start, check, doc))
    doc, check, start, end = doc[o], check[o], start[o], end[o]
    new = np.append(True, (doc[1:] != doc[:-1]) | (check[1:] != check[:-1]))
    # ends run on from one text to the next when every text has a range of its own
    base = (np.cumsum(new) - 1) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    at = np.flatnonzero(np.append(True, (start + base)[1:] > reach[:-1]))
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], check[at], start[at], reach[last] - base[last]


def merge(spans: np.ndarray) -> np.ndarray:
    """Spans ``[start, end)`` as disjoint, not touching, sorted spans."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > ends[:-1])
    at = np.flatnonzero(new)
    return np.column_stack([spans[at, 0], ends[np.append(at[1:], len(spans)) - 1]])


_MARKS = pa.schema([("doc_id", pa.int64()), ("marks", pa.binary())])


def _mark_rows(*marks: np.ndarray) -> pa.RecordBatch:
    """One row per (document, checksum): its merged spans (columns doc, check, start, end)."""
    doc, check, start, end = merge_marks(*marks)
    out = np.empty(len(doc), _MARK)
    out["check"], out["start"], out["end"] = check, start, end
    at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (check[1:] != check[:-1]))[:len(doc)])
    cuts = np.append(at, len(doc)).tolist()
    return pa.RecordBatch.from_arrays([
        pa.array(doc[at], pa.int64()),
        pa.array([out[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)],
                 pa.binary())], schema=_MARKS)


_FOUND_DDL = "route long, giant int, packed binary"
_FOUND = pa.schema([("route", pa.int64()), ("giant", pa.int32()), ("packed", pa.binary())])


def _found_marks(marks: tuple[np.ndarray, ...], bins: int) -> pa.RecordBatch:
    """Merged spans, packed by range of documents."""
    doc, check, start, end = merge_marks(*marks)
    b = _bin(_spread(doc), bins)
    order = np.argsort(b, kind="stable")
    b = b[order]
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])[:len(b)])
    blobs = [_pack(doc[o], check[o].astype(np.uint32), start[o], end[o])
             for o in np.split(order, cut[1:])] if len(cut) else []
    return pa.RecordBatch.from_arrays([
        pa.array(b[cut].astype(np.int64)), pa.array(np.zeros(len(blobs), np.int32)),
        pa.array(blobs, pa.binary())], schema=_FOUND)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _string_marks(strings: np.ndarray, doc: np.ndarray, check: np.ndarray, place: np.ndarray
                  ) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Of equal strings (rows of ``strings``): which are of the smallest document; marks of the rest."""
    v = np.ascontiguousarray(strings).view(f"V{LENGTH}").reshape(-1)
    order = np.argsort(v, kind="stable")
    v = v[order]
    at = np.flatnonzero(np.append(True, v[1:] != v[:-1])[:len(v)])
    rank = _rank(doc)
    least = np.empty(len(v), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(rank[order], at),
                             np.diff(np.append(at, len(v)))) if len(at) else 0
    hit = rank > least
    return ~hit, (doc[hit], check[hit], place[hit], place[hit] + LENGTH)


def _found_strings(t: pa.Table, bins: int) -> Iterator[pa.RecordBatch]:
    """The strings of a key's fragments, packed by ranges of their hashes.

    Of equal strings only those of the smallest document go; the others are
    marked at once.
    """
    held = np.cumsum(pc.binary_length(t.column("bytes")).to_numpy().astype(np.int64))
    cuts = np.flatnonzero(np.diff(held // STRING_SLICE)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), t.num_rows], strict=True):
        part = t.slice(lo, hi - lo).to_pydict()
        data = np.frombuffer(b"".join(part["bytes"]), np.uint8)
        sizes = np.array([len(x) for x in part["bytes"]])
        places = [np.frombuffer(x, "<i8") for x in part["places"]]
        starts = np.cumsum(sizes) - sizes
        # a row per string and place of its fragment
        times = np.array([len(p) for p in places])
        frag = np.repeat(np.arange(len(sizes)), times)
        count = sizes[frag] - LENGTH + 1
        which = np.repeat(np.arange(len(frag)), count)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        at = starts[frag[which]] + inside
        place = np.concatenate(places)[which] + inside
        doc = np.array(part["doc_id"], np.int64)[frag[which]]
        check = np.array(part["check"], np.int64)[frag[which]]
        strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]
        first, marks = _string_marks(strings, doc, check, place)
        yield _found_marks(marks, bins)
        strings, doc, check, place, at = (x[first] for x in (strings, doc, check, place, at))
        w = _words(np.concatenate([data, np.zeros(8, np.uint8)]), len(data), "<")
        h = np.zeros(len(at), np.uint64)
        for o in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
            h = mix(h ^ w[at + o])
        b = _bin(h, bins * STRING_BINS)
        order = np.argsort(b, kind="stable")
        b = b[order]
        cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])[:len(b)])
        blobs = [_pack(doc[o], check[o].astype(np.uint32), place[o], strings[o].reshape(-1))
                 for o in np.split(order, cut[1:])] if len(cut) else []
        n = len(blobs)
        yield pa.RecordBatch.from_arrays([
            pa.array(b[cut].astype(np.int64)), pa.array(np.ones(n, np.int32)),
            pa.array(blobs, pa.binary())], schema=_FOUND)


def compare(parts: list[dict]) -> tuple[np.ndarray, ...]:
    """Marks (columns doc, check, start, end) among whole keys of fragments."""
    distinct: dict[bytes, list[tuple[int, int, bytes]]] = {}
    kinds: dict[int, int] = {}                  # different fragments of a key
    keys: dict[bytes, int] = {}
    for p in parts:
        for key, part, d, check, places in zip(p["key"], p["bytes"], p["doc_id"], p["check"],
                                               p["places"], strict=True):
            held = distinct.get(part)
            if held is None:
                kinds[key] = kinds.get(key, 0) + 1
                keys[part] = key
                distinct[part] = [(d, check, places)]
            else:
                held.append((d, check, places))
    # marks as (document, checksum, places as bytes, first and last byte from a place on)
    docs, checks, where, lows, highs = [], [], [], [], []
    frags, least_of, owners = [], [], []
    for part, held in distinct.items():
        alone = len(held) == 1
        least = _rank_of(held[0][0]) if alone else min(_rank_of(w[0]) for w in held)
        if not alone:
            for d, check, places in held:
                if _rank_of(d) > least:         # all its strings stand in a smaller document
                    docs.append(d)
                    checks.append(check)
                    where.append(places)
                    lows.append(0)
                    highs.append(len(part))
        if kinds[keys[part]] > 1:               # else its strings stand nowhere else
            frags.append(part)
            least_of.append(least)
            owners.append(held if alone else [w for w in held if _rank_of(w[0]) == least])
    for f, lo, hi in runs(*repeated_places(frags, np.array(least_of, np.int64))) if frags else ():
        for d, check, places in owners[f]:
            docs.append(d)
            checks.append(check)
            where.append(places)
            lows.append(lo)
            highs.append(hi + LENGTH)
    times = np.array([len(w) // 8 for w in where], np.int64)
    at = np.frombuffer(b"".join(where), "<i8")
    return (np.repeat(np.array(docs, np.int64), times), np.repeat(np.array(checks, np.int64), times),
            at + np.repeat(np.array(lows, np.int64), times),
            at + np.repeat(np.array(highs, np.int64), times))


def _suffix_kernel(limit: int, bins: int):
    """Marks from the suffix arrays of whole keys (rows sorted by marked, key).

    Keys with more than ``limit`` bytes give their strings instead.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []

        def open_ones() -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = b.column("marked").to_numpy() == 1
                if m.any():
                    done.append(b.filter(pa.array(m)))
                if not m.all():
                    yield b.filter(pa.array(~m))

        def passed() -> Iterator[pa.RecordBatch]:
            while done:
                t = done.pop()
                places = t.column("places")
                times = pc.binary_length(places).to_numpy() // 16
                spans = np.frombuffer(b"".join(places.to_pylist()), "<i8").reshape(-1, 2)
                yield _found_marks((np.repeat(t.column("doc_id").to_numpy(), times),
                                    np.repeat(t.column("check").to_numpy(), times),
                                    spans[:, 0], spans[:, 1]), bins)

        held: list[dict] = []
        marks: list[tuple[np.ndarray, ...]] = []
        size = 0
        for giant, t in _groups(open_ones(), "key", limit):
            if giant:
                yield from _found_strings(t, bins)
            else:
                rows = t.to_pydict()
                held.append(rows)
                size += sum(map(len, rows["bytes"]))
            if size >= SORT_BYTES:
                marks.append(compare(held))
                held, size = [], 0
            if sum(len(m[0]) for m in marks) >= MARKS:
                yield _found_marks(_joined(marks), bins)
                marks = []
            yield from passed()
        yield _found_marks(_joined([*marks, compare(held)]), bins)
        yield from passed()
    return run


def _string_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of a range (rows sorted by giant, route): its marks merged.

    Of a very large key's strings: marks of equal strings of larger documents.
    """
    def settle(giant: int, held: list[bytes]) -> pa.RecordBatch:
        doc, check, *rest = (np.concatenate(x) for x in zip(*map(_unpack, held), strict=True))
        doc, check, first = doc.view(np.int64), check.astype(np.int64), rest[0].view(np.int64)
        if giant:
            return _mark_rows(*_string_marks(rest[1].reshape(-1, LENGTH), doc, check, first)[1])
        return _mark_rows(doc, check, first, rest[1].view(np.int64))

    held: list[bytes] = []
    now = None
    for b in batches:
        for giant, route, blob in zip(*(b.column(c).to_pylist() for c in ("giant", "route", "packed")),
                                      strict=True):
            if (giant, route) != now and held:
                yield settle(now[0], held)
                held = []
            now = (giant, route)
            held.append(blob)
    if held:
        yield settle(now[0], held)


def _removal_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: what its marks remove."""
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for raw, marks in zip(_texts(b), b.column("marks").to_pylist(), strict=True):
            spans = np.zeros((0, 2), np.int64)
            if marks:
                m = np.frombuffer(b"".join(marks), _MARK)
                m = m[m["check"] == zlib.crc32(raw)]
                spans = merge(np.column_stack([m["start"], m["end"]]))
            digest, at = hashlib.sha256(), 0
            for s, e in spans.tolist():
                digest.update(raw[at:s])
                at = e
            digest.update(raw[at:])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int((spans[:, 1] - spans[:, 0]).sum()))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(digest.hexdigest())
        yield pa.RecordBatch.from_pydict({
            "doc_id": b.column("doc_id"),
            **{c: pa.array(v, pa.string() if c == "kept_sha256" else pa.int64())
               for c, v in out.items()}})


def _dealt(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows of one bin in one task, and one bin in each task.

    ``repartition`` deals by a hash, which would put four bins into some tasks
    and none into others.  For each task the least number that the hash sends
    there is looked up; a bin goes under that number.
    """
    spark = df.sparkSession
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(bins)).cast("int")
    least = {r["place"]: r["id"] for r in spark.range(24 * bins).groupBy(place.alias("place"))
             .agg(F.min("id").alias("id")).collect()}
    routes = F.array(*[F.lit(least.get(i, i)).cast("int") for i in range(bins)])
    return df.withColumn("dealt", F.get(routes, F.pmod(F.col(column), F.lit(bins)).cast("int"))) \
             .repartition(bins, "dealt").drop("dealt")


def repeats(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    anonymous = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text_of()), 24)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), anonymous).alias("doc_id"),
                    text_of().alias("text"))
    bins = shuffle_partitions(docs.sparkSession)
    keys = (_dealt(d.mapInArrow(_key_kernel(bins), "bin int, proved int, pairs binary"), "bin", bins)
             .sortWithinPartitions("proved", "bin")
             .mapInArrow(_answer_kernel, "doc_id long, key long")
             .groupBy("doc_id").agg(F.collect_set("key").alias("keys")))
    fragments_found = d.join(keys, "doc_id").mapInArrow(_fragment_kernel(bins),
                                                        "bin int, marked int, rows binary")
    found = (_dealt(fragments_found, "bin", bins).mapInArrow(_unfold_kernel, _FRAGMENT_DDL)
              .sortWithinPartitions("marked", "key")
              .mapInArrow(_suffix_kernel(group_bytes, bins), _FOUND_DDL))
    marks = (found.repartition("route").sortWithinPartitions("giant", "route")
                  .mapInArrow(_string_kernel, "doc_id long, marks binary")
                  .groupBy("doc_id").agg(F.collect_list("marks").alias("marks")))
    return (d.join(marks, "doc_id", "left")
             .mapInArrow(_removal_kernel, "doc_id long, n_bytes long, n_removed long, "
                                          "n_spans long, kept_sha256 string")
             .withColumn("doc_id", F.when(F.col("doc_id") >= NO_ID + ANON, F.col("doc_id"))))
