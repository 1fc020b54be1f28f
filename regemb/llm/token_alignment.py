"""Alignment of two tokenizers by interval coalescing (operator 13).

Both tokenizers cut the same bytes (a space and the text), so their tokens are
two tilings of one line.

1. **Coalescing.**  All A and B tokens of a slice of texts are sorted by start
   (``lexsort``), the running maximum of their ends is taken
   (``maximum.accumulate``), and a new group begins where a start reaches it:
   there a token of A and one of B end together.
2. **Overlaps.**  Inside a group every stretch between neighbouring ends lies in
   one token of A and one of B and is their link; no pair of tokens is tried.
3. **Blocks.**  A task packs the texts of about :data:`BLOCK_BYTES` bytes into one
   row: facts and links by document, and the block's distinct id pairs with the
   number of its documents that hold them.  Blocks are stored once, so each
   text is tokenized once.
4. **Corpus counts.**  Pairs are summed over blocks; a window over the A id (at
   most as many rows as B has ids) finds its highest count.
5. **Back to documents.**  A block asks for its own pairs only: one row per block
   and distinct pair is joined to the counts and travels back to the block,
   where links are added up.  Nothing is broadcast and nothing grows with a pair
   that all documents share: it is one row per block.

Null or empty text, and text whose joined token bytes on either side differ
from a space and the text (a literal U+2581, say), has no tokens: zeros and an
empty digest.  Repeated rows count as documents of their own.  Extra columns
are ignored; an empty table gives no rows.  Memory of a task is in proportion
to its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regemb.llm.base import id_and_text, stored

SLICE_BYTES = 1_000_000      # text that is aligned at a time
BLOCK_BYTES = 8_000_000      # text of one stored block
BLOCK_DOCS = 20_000
#: Factor between an A id and a B id in a pair's number; B has fewer ids.
B_BITS = 20
B_IDS = 1 << B_BITS


class Tokenizers:
    """Ids and token bytes of both tokenizers."""

    def __init__(self, ranks_path: str, piece_path: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN,
                                   mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if len(self.b_bytes) > B_IDS:
            raise ValueError(f"more than {B_IDS} B ids")
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # an id and what follows it: the same side, the other side, the next group
        self.written = [f"{i}{c}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))
                        for c in ",|;"]

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """A and B ids of each text; none where either side does not give the bytes back."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = (" " + text).encode()
            a = self.a.encode_ordinary(" " + text) if text else []
            same = (text and self.a.decode_bytes(a) == whole
                    and b"".join(map(self.b_bytes.__getitem__, b)) == whole)
            out.append((a, b) if same else ([], []))
        return out


@dataclass
class Aligned:
    """Groups and links of a slice of texts."""

    side: np.ndarray         # of every token, by (group, side, start)
    ids: np.ndarray
    group: np.ndarray        # numbered through the slice
    document: np.ndarray     # of every group
    links: np.ndarray        # pair numbers
    link_document: np.ndarray


def align(a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray,
          text_ends: np.ndarray) -> Aligned:
    """Coalesce the tokens of texts that lie end to end (token sizes in bytes, ends of texts)."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    start = np.concatenate([a_ends - a_sizes, b_ends - b_sizes])
    end = np.concatenate([a_ends, b_ends])
    side = np.concatenate([np.zeros(len(a_ids), np.int8), np.ones(len(b_ids), np.int8)])
    ids = np.concatenate([a_ids, b_ids])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    opens = np.ones(len(order), bool)
    opens[1:] = start[order][1:] >= reach[:-1]
    group = np.cumsum(opens) - 1
    by_side = np.lexsort((side[order], group))
    # stretches between neighbouring ends are the links
    ends = np.concatenate([a_ends, b_ends])
    ends.sort(kind="stable")                 # two rising runs: one merge
    ends = ends[np.append(True, ends[1:] != ends[:-1])[:len(ends)]]
    links = (a_ids[np.searchsorted(a_ends, ends)] * B_IDS + b_ids[np.searchsorted(b_ends, ends)])
    return Aligned(side[order][by_side], ids[order][by_side], group[by_side],
                   np.searchsorted(text_ends, start[order][opens], side="right"),
                   links, np.searchsorted(text_ends, ends))


def _texts_by_slice(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE_BYTES:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def _lay_out(tokenizers: Tokenizers, texts: list[str]):
    """Alignment of a slice: token numbers per text, and the texts that have tokens."""
    pairs = tokenizers.encode(texts)
    n_a = np.array([len(a) for a, _ in pairs], np.int64)
    n_b = np.array([len(b) for _, b in pairs], np.int64)
    if not n_a.sum():
        return n_a, n_b, None
    a = np.concatenate([np.array(x, np.int64) for x, _ in pairs])
    b = np.concatenate([np.array(y, np.int64) for _, y in pairs])
    a_sizes, b_sizes = tokenizers.a_sizes[a], tokenizers.b_sizes[b]
    laid = np.concatenate([[0], np.cumsum(a_sizes)])
    text_ends = laid[np.cumsum(n_a)]
    return n_a, n_b, align(a, b, a_sizes, b_sizes, text_ends)


def _written_groups(tokenizers: Tokenizers, x: Aligned) -> list[str]:
    """Every token with the sign that follows it, in order of (group, side, start)."""
    follows = np.full(len(x.ids), 2, np.int64)
    same = x.group[1:] == x.group[:-1]
    follows[:-1][same] = (x.side[1:] != x.side[:-1])[same]
    return list(map(tokenizers.written.__getitem__, (x.ids * 3 + follows).tolist()))


DOCUMENTS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
BLOCKS = "block long, pairs array<long>, documents array<int>, facts binary"


class _Block:
    """Facts of documents and their links, until they are written as one row."""

    def __init__(self):
        self.facts: list[tuple] = []
        self.size = 0
        self.pairs: list[np.ndarray] = []       # distinct per document
        self.times: list[np.ndarray] = []
        self.held: list[np.ndarray] = []        # number of distinct pairs per document

    def add(self, doc_ids: list, texts: list[str], tokenizers: Tokenizers) -> None:
        n_a, n_b, x = _lay_out(tokenizers, texts)
        n = len(texts)
        self.size += sum(map(len, texts)) + n
        digests = [""] * n
        groups = links = held = np.zeros(n, np.int64)
        if x is not None:
            groups = np.bincount(x.document, minlength=n)
            links = np.bincount(x.link_document, minlength=n)
            written, at = _written_groups(tokenizers, x), 0
            for i, tokens in enumerate((n_a + n_b).tolist()):
                if tokens:
                    text = "".join(written[at:at + tokens])[:-1]
                    digests[i] = hashlib.sha256(text.encode()).hexdigest()
                    at += tokens
            order = np.lexsort((x.links, x.link_document))
            doc, pair = x.link_document[order], x.links[order]
            new = np.ones(len(pair), bool)
            new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
            at_new = np.flatnonzero(new)
            self.pairs.append(pair[at_new])
            self.times.append(np.diff(np.append(at_new, len(pair))))
            held = np.bincount(doc[at_new], minlength=n)
        self.held.append(held)
        self.facts += zip(doc_ids, n_a.tolist(), n_b.tolist(), groups.tolist(), links.tolist(),
                          digests, strict=True)

    def row(self, block: int) -> tuple:
        none = [np.zeros(0, np.int64)]
        pairs = np.concatenate(self.pairs or none)
        distinct, where, documents = np.unique(pairs, return_inverse=True, return_counts=True)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(self.held))])
        facts = pa.RecordBatch.from_pydict({
            **{k: pa.array(v, pa.string() if k == "groups_sha256" else pa.int64())
               for k, v in zip(DOCUMENTS, zip(*self.facts, strict=True), strict=True)},
            "pairs": pa.ListArray.from_arrays(bounds.astype(np.int32), where.astype(np.int32)),
            "times": pa.ListArray.from_arrays(
                bounds.astype(np.int32), np.concatenate(self.times or none).astype(np.int32))})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, facts.schema,
                               options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(facts)
        return block, distinct, documents, sink.getvalue().to_pybytes()


def _blocks_kernel(ranks_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        tokenizers = Tokenizers(ranks_path, piece_path)
        number = TaskContext.get().partitionId() << 32
        block = _Block()

        def out():
            nonlocal block, number
            n, pairs, documents, facts = block.row(number)
            block, number = _Block(), number + 1
            bounds = pa.array([0, len(pairs)], pa.int32())
            return pa.RecordBatch.from_pydict({
                "block": pa.array([n], pa.int64()),
                "pairs": pa.ListArray.from_arrays(bounds, pa.array(pairs, pa.int64())),
                "documents": pa.ListArray.from_arrays(bounds, pa.array(documents, pa.int32())),
                "facts": pa.array([facts], pa.binary())})

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for first, part in _texts_by_slice(texts):
                block.add(ids[first:first + len(part)], part, tokenizers)
                if block.size >= BLOCK_BYTES or len(block.facts) >= BLOCK_DOCS:
                    yield out()
        if block.facts:
            yield out()
    return run


def blocks(docs: DataFrame, ranks_path: str, piece_path: str) -> DataFrame:
    """Aligned documents in blocks, stored."""
    return stored(id_and_text(docs).mapInArrow(_blocks_kernel(ranks_path, piece_path), BLOCKS),
                  "blocks")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: documents that hold a pair, and whether no pair of its A id has more."""
    n = (aligned.select(F.explode(F.arrays_zip("pairs", "documents")).alias("x"))
                .groupBy(F.col("x.pairs").alias("pair"))
                .agg(F.sum("x.documents").cast("long").alias("n")))
    by_a = Window.partitionBy(F.shiftright("pair", B_BITS))
    return n.select("pair", "n", (F.col("n") == F.max("n").over(by_a)).alias("best"))


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
          "count_sum long, groups_sha256 string")


def _documents_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a block's pairs, in order, followed by its facts, to its documents."""
    counts: list[np.ndarray] = []
    bests: list[np.ndarray] = []

    def sums(values, times, where, bounds):
        total = np.concatenate([[0], np.cumsum(values[where] * times)])
        return pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.int64())

    for b in batches:
        facts = b.column("facts")
        heads = np.flatnonzero(facts.is_valid().to_numpy(zero_copy_only=False))
        n = b.column("n").fill_null(0).to_numpy()
        best = b.column("best").fill_null(0).to_numpy()
        at = 0
        for h in heads.tolist():
            counts.append(n[at:h])
            bests.append(best[at:h])
            at = h + 1
            n_of, best_of = np.concatenate(counts), np.concatenate(bests)
            counts, bests = [], []
            with pa.ipc.open_stream(facts[h].as_buffer()) as r:
                d = r.read_next_batch()
            bounds = d.column("pairs").offsets.to_numpy()
            where = d.column("pairs").values.to_numpy()
            times = d.column("times").values.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                **{k: d.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
                "n_best": sums(best_of, times, where, bounds),
                "count_sum": sums(n_of, times, where, bounds),
                "groups_sha256": d.column("groups_sha256")})
        counts.append(n[at:])
        bests.append(best[at:])


def documents(docs: DataFrame, ranks_path: str, piece_path: str) -> DataFrame:
    """One row per document: tokens, groups, links, and what the corpus says of its links."""
    aligned = blocks(docs, ranks_path, piece_path)
    counted = stored(pair_counts(aligned), "pairs")
    none = F.lit(None).cast("long")
    wanted = (aligned.select("block", F.explode("pairs").alias("pair")).join(counted, "pair")
                     .select("block", "pair", "n", F.col("best").cast("long").alias("best"),
                             F.lit(None).cast("binary").alias("facts")))
    heads = aligned.select("block", F.lit((1 << 63) - 1).alias("pair"), none.alias("n"),
                           none.alias("best"), "facts")
    return (wanted.unionByName(heads).repartition("block").sortWithinPartitions("block", "pair")
                  .mapInArrow(_documents_kernel, RESULT))


GROUPS = "doc_id long, group long, a_ids array<int>, b_ids array<int>"


def _groups_kernel(ranks_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(ranks_path, piece_path)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for first, part in _texts_by_slice(texts):
                _, _, x = _lay_out(tokenizers, part)
                if x is None:
                    continue
                n = len(x.document)

                def side(k, x=x, n=n):
                    mine = x.side == k
                    bounds = np.concatenate([[0], np.cumsum(np.bincount(x.group[mine], minlength=n))])
                    return pa.ListArray.from_arrays(bounds.astype(np.int32),
                                                    x.ids[mine].astype(np.int32))

                new = np.ones(n, bool)
                new[1:] = x.document[1:] != x.document[:-1]
                first_of = np.maximum.accumulate(np.where(new, np.arange(n), 0))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[first + d] for d in x.document.tolist()], pa.int64()),
                    "group": pa.array(np.arange(n) - first_of, pa.int64()),
                    "a_ids": side(0), "b_ids": side(1)})
    return run


def groups(docs: DataFrame, ranks_path: str, piece_path: str) -> DataFrame:
    """``doc_id, group, a_ids, b_ids``: the smallest runs of tokens that cover the same bytes."""
    return id_and_text(docs).mapInArrow(_groups_kernel(ranks_path, piece_path), GROUPS)
