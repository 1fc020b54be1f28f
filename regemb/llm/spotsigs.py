"""Document fingerprints from spot signatures (operator 2), DataFrame functions only.

A *spot* is a common word (an anchor); its signature is the anchor plus the
chain of up to ``CHAIN`` content words that follow it, anchors in between
skipped (a run of more than ``SKIP`` anchors ends the chain).  The start of a
text counts as a spot too, so short texts have a signature.

Content words that follow more than ``CHAIN`` content words without an anchor
lie in no chain (tables, code, other languages).  They are cut into pieces
after the words whose hash is a multiple of ``CHAIN``, at the latest after
``PIECE`` words; each piece together with the one before it (the first: with
the ``CHAIN`` words before it) is a signature.  So every content word is in a
signature, and an edit changes only those around it.  The fingerprint
is the set of 64-bit hashes of a text's signatures; written as a string it is
the sorted hashes in hex, so equal texts have equal fingerprints.

Two fingerprints compare by Jaccard.  :func:`similar` finds all pairs of at
least ``threshold``: sets are partitioned by length (lengths whose ratio falls
below the threshold never meet) and, within a length class, joined on the few
signatures one of which two such sets must share (prefix of the sorted
hashes); only those pairs are compared in full.  Equal sets are joined once,
through one representative.

Words are runs of letters and digits, in lower case.  A text without content
words has one signature: its words, or else its characters.  Null counts as
empty; the empty text has the empty set, which is like itself (1) and unlike
any other (0).  Repeated rows give repeated results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regemb.llm.base import id_and_text, stored

CHAIN = 3
SKIP = 12
PIECE = 12
NEAR = 0.8
BUCKET_ROWS = 500       # neighbours by id that one window partition holds, about
MAX_BUCKETS = 1 << 16  # beyond 32 million rows a bucket has more of them

# Common words of four languages.
COMMON = {
    "en": "a about after all also an and any are as at be been but by can do for from had has "
          "have he her his if in into is it its more no not of on one or our out she so some "
          "than that the their them then there these they this to up was we were what when "
          "which who will with would you your",
    "de": "als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem "
          "einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so "
          "über um und von vor war wie wird zu zum zur",
    "fr": "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais "
          "ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous à été",
    "es": "al como con de del el ella en es esta este fue ha la las le lo los más no o para pero "
          "por que se sin su sus un una y ya",
}
ANCHORS = sorted({w for words in COMMON.values() for w in words.split()})
_MARK = "¤"


def _trie_pattern(words: list[str]) -> str:
    """An alternation that reads each letter once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [c + _trie_pattern(rest) if rest != [""] else c
             for c, rest in heads.items() if c]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)})" + ("?+" if "" in heads else "")


_ANCHOR = f" ({_trie_pattern(ANCHORS)})(?= )"
_SPOT = (rf"{_MARK}(?=([^ ]++(?: {_MARK}[^ ]++){{0,{SKIP}}}+"
         rf"(?: [^ {_MARK}][^ ]*+(?: {_MARK}[^ ]++){{0,{SKIP}}}+){{1,{CHAIN}}}))")
# A run of more than CHAIN content words; its first CHAIN words, then its pieces
# (in a run the mark follows the words after which a piece ends).
_WORD = rf"[^ {_MARK}]++"
_RUN = rf" ({_WORD}(?: {_WORD}){{{CHAIN - 1}}} [^ {_MARK}][^{_MARK}]*+)"
_PIECES = (rf"^{_WORD}{_MARK}?(?: {_WORD}{_MARK}?){{{CHAIN - 1}}}"
           rf"|(?: {_WORD}(?!{_MARK})){{0,{PIECE - 1}}}+ {_WORD}{_MARK}"
           rf"|(?: {_WORD}(?!{_MARK})){{1,{PIECE}}}+")


def marked(text: Column) -> Column:
    """Lower-case words with one blank around each; anchors carry a mark."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), _ANCHOR, f" {_MARK}$1")


def _run_pieces(run: Column) -> Column:
    """The first ``CHAIN`` words of a run and the pieces of the others."""
    ends = F.transform(F.split(F.rtrim(run), " "), lambda w: F.when(
        F.pmod(F.xxhash64(w), F.lit(CHAIN)) == 0, F.concat(w, F.lit(_MARK))).otherwise(w))
    return F.regexp_extract_all(F.array_join(ends, " "), F.lit(_PIECES), F.lit(0))


def _piece_hashes(pieces: Column) -> Column:
    """Each piece but the first hashed with the one before it."""
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)),
                       lambda p, i: F.xxhash64(F.concat(pieces[i], p)))


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: the sorted distinct hashes of the signatures of column ``text``."""
    m = f"__{name}_marked"
    spots = F.regexp_extract_all(F.concat(F.lit(f" {_MARK}^"), F.col(m)), F.lit(_SPOT), 1)
    chains = F.transform(spots, lambda s: F.xxhash64(
        F.regexp_replace(s, f" {_MARK}[^ ]+", "")))
    runs = F.transform(F.regexp_extract_all(F.col(m), F.lit(_RUN), F.lit(1)), _run_pieces)
    between = F.flatten(F.transform(runs, _piece_hashes))
    out = (df.withColumn(m, marked(F.col(text)))
             .withColumn(name, F.sort_array(F.array_distinct(F.concat(chains, between))))
             .withColumn(name, F.when(F.size(name) > 0, F.col(name))
                         .when(F.length(F.trim(m)) > 0, F.array(F.xxhash64(m)))
                         .when(F.length(text) > 0, F.array(F.xxhash64(text)))
                         .otherwise(F.col(name))))
    return out.drop(m)


def fingerprint(signatures: str) -> Column:
    """A signature set as a string: sixteen hex digits per hash, in order."""
    return F.array_join(F.transform(
        signatures, lambda s: F.lower(F.lpad(F.hex(s), 16, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard of two signature sets; an empty set is compared without a look at the other."""
    both = F.size(F.array_intersect(a, b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
             .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
             .otherwise(both / (F.size(a) + F.size(b) - both)))


def similar(docs: DataFrame, threshold: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: the class of every document, and pairs of classes that are near.

    ``members``: ``doc_id, class_id`` (smallest id with the same signature set);
    ``pairs``: ``class_a, class_b, likeness``, each pair once.
    """
    marked_docs = with_signatures(id_and_text(docs), "text", "signatures")
    # a set is named by two hashes: ids may repeat or be null
    keyed = marked_docs.select("doc_id", "signatures", F.struct(
        F.xxhash64("signatures").alias("h"),
        F.xxhash64(F.lit(1), "signatures").alias("g")).alias("set"))
    sets = stored(keyed.groupBy("set", "signatures").agg(F.min("doc_id").alias("class_id")),
                  "spots-sets")
    members = keyed.join(sets.select("set", "signatures", "class_id"), ["set", "signatures"]) \
                   .select("doc_id", "class_id")
    n = F.size("signatures")
    step = math.log(1.0 / threshold)
    level = F.floor(F.log(n.cast("double")) / step).cast("int")
    prefix = F.slice("signatures", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    lean = (sets.where(n > 0)
            .select("set", n.alias("n"), level.alias("level"), prefix.alias("prefix")))
    short = lean.select("set", "n", F.explode("prefix").alias("s"), "level")
    long = (lean.select(F.col("set").alias("set_b"), F.col("n").alias("n_b"), "prefix",
                        F.explode(F.array(F.col("level"), F.col("level") - 1)).alias("level"))
            .select("set_b", "n_b", "level", F.explode("prefix").alias("s")))
    near = (short.join(long, ["level", "s"])
            .where((F.col("n") >= F.col("n_b") * threshold - 1e-9) & (
                (F.col("n") < F.col("n_b"))
                | ((F.col("n") == F.col("n_b")) & (F.col("set") < F.col("set_b")))))
            .select("set", "set_b").distinct())
    a = sets.select("set", F.col("class_id").alias("ia"), F.col("signatures").alias("sa"))
    b = sets.select(F.col("set").alias("set_b"), F.col("class_id").alias("ib"),
                    F.col("signatures").alias("sb"))
    swap = F.col("ib").isNotNull() & (F.col("ia").isNull() | (F.col("ib") < F.col("ia")))
    pairs = (near.join(a, "set").join(b, "set_b")
             .withColumn("likeness", likeness("sa", "sb"))
             .where(F.col("likeness") >= threshold)
             .select(F.when(swap, F.col("ib")).otherwise(F.col("ia")).alias("class_a"),
                     F.when(swap, F.col("ia")).otherwise(F.col("ib")).alias("class_b"),
                     "likeness"))
    return members, pairs


def _numbers(values: list[int]) -> Column:
    """A long array as one folded literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(docs: DataFrame, carry: str = "text") -> DataFrame:
    """Each row with ``next_<carry>`` of the row that follows in descending id order.

    The row with the smallest id is followed by the one with the largest.
    Rows are dealt into buckets of neighbouring ids; the largest row of each
    bucket is also put in front of the next bucket, so one shuffle is enough.
    Null ids count as smallest; rows that repeat an id follow by text.
    """
    low = -(1 << 63)
    rows = docs.withColumn("__id", F.coalesce(F.col("doc_id"), F.lit(low)))
    ids = rows.select("__id")
    n = ids.count()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    cuts: list[int] = []
    if buckets > 1:
        shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        found = ids.agg(F.percentile_approx("__id", shares, 20 * buckets).alias("c")).first()["c"]
        cuts = sorted(set(found))
    width = max(1, math.isqrt(len(cuts)))
    if cuts:
        outer = F.size(F.filter(_numbers(cuts[::width]), lambda c: c < F.col("__id")))
        start = F.greatest(outer - 1, F.lit(0)) * width
        inner = F.size(F.filter(F.slice(_numbers(cuts), start + 1, width),
                                lambda c: c < F.col("__id")))
        rows = rows.withColumn("__bucket", F.when(outer == 0, F.lit(0)).otherwise(start + inner))
    else:
        # one bucket: its largest row also goes in front, nothing to join
        top = ids.agg(F.max("__id")).first()[0]
        own = F.struct(F.lit(0).alias("b"), F.lit(1).alias("own"))
        front = F.struct(F.lit(0).alias("b"), F.lit(0).alias("own"))
        put = F.when(F.col("__id") == F.lit(top), F.array(own, front)).otherwise(F.array(own))
        return (rows.withColumn("__put", F.explode(put))
                    .withColumns({"__bucket": F.col("__put.b"), "__own": F.col("__put.own")})
                    .drop("__put").repartition("__bucket"))
    # at most MAX_BUCKETS rows of 24 bytes: the bound makes the broadcast safe
    edges = rows.groupBy("__bucket").agg(F.max("__id").alias("__top"))
    edges = stored(edges, "spots-edges")
    order = [(r["__bucket"], r["__top"]) for r in edges.orderBy("__bucket").collect()]
    follow = [(b, t, order[(i + 1) % len(order)][0]) for i, (b, t) in enumerate(order)]
    edge_table = docs.sparkSession.createDataFrame(
        follow, "__bucket int, __top long, __after int")
    placed = (rows.withColumn("__bucket", F.col("__bucket").cast("int"))
              .join(F.broadcast(edge_table), "__bucket")
              .withColumn("__put", F.when(
                  F.col("__id") == F.col("__top"),
                  F.array(F.struct(F.col("__bucket").alias("b"), F.lit(1).alias("own")),
                          F.struct(F.col("__after").alias("b"), F.lit(0).alias("own"))))
                  .otherwise(F.array(F.struct(F.col("__bucket").alias("b"),
                                              F.lit(1).alias("own")))))
              .withColumn("__put", F.explode("__put"))
              .withColumns({"__bucket": F.col("__put.b"), "__own": F.col("__put.own")})
              .drop("__put", "__top", "__after"))
    return placed.repartition("__bucket")


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Every document with its signatures, those of its edited text and of the next document.

    The edited text has its last ``floor(n / 2)`` code points replaced by the
    first as many (or all) of the next document.
    """
    placed = with_signatures(with_next(id_and_text(docs)), "text", "signatures")
    before = Window.partitionBy("__bucket").orderBy("__own", "__id", "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    keep = (F.col("n_chars") - half).cast("int")
    rows = (placed.withColumns({"next_text": F.lag("text").over(before),
                                "next_signatures": F.lag("signatures").over(before)})
            .where("__own = 1")
            .withColumn("n_chars", F.char_length("text").cast("long"))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), keep),
                                           F.substring("next_text", F.lit(1), half))))
    return with_signatures(rows, "edited", "edited_signatures")
