"""Toxicity by a weighted lexicon (operator 10).

* **Folding.**  Text is lower-cased, homoglyphs (Cyrillic, Greek, full-width
  letters) become Latin letters, and digits or signs that stand between
  letters become the letters they imitate (``1d10t`` -> ``idiot``).
* **Lexicon.**  Whole words and stems (``stem*``, word beginnings) with a
  weight.  Weights are smoothed log-odds of the term among toxic and clean
  labelled rows; terms are taken by weight and support, and of two terms one of
  which begins with the other only the stronger (else the longer) stays.  The built-in seed
  words fill in for what the labels do not show.
* **Matching.**  One Aho-Corasick automaton over the folded words; the word
  border is part of every pattern.  Hits inside an exception phrase
  (``trash can``) do not count.
* **Score.**  Logistic in (hits, summed weight, weight per word): the last is
  the normalisation by length.  The three coefficients are fitted on the same
  labelled rows as the lexicon.

The fit uses at most ``max_rows`` labelled rows, the smallest by a hash of the
id, so any engine layout picks the same rows.  It never sees language, source
or id.  Scoring reads every row and whole text.

Null or empty text has no hits and scores the intercept.  Null ids keep their
row (crc32 of the empty text decides their fold).  Repeated rows score alike.
Without usable labels (empty table, one class only) the seed words decide with
fixed coefficients.  Extra columns are ignored by :func:`score_documents` and kept by
:func:`drop_toxic`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regemb.llm.base import crc_of_id, drawn, id_and_text

MAX_ROWS = 20_000      # labelled rows of the fit
MAX_TERMS = 256        # size of the lexicon
MIN_SUPPORT = 4        # toxic rows that hold a term
MIN_LOG_ODDS = 3.0
STEM_LENGTHS = range(3, 9)
THRESHOLD = 0.3

# Letters that look alike.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ո": "n",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
# Seed words, and phrases in which they mean no harm.
SEED_WORDS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless",
              "disgusting", "clown", "imbecile", "dumbass", "asshole", "bastard", "bitch",
              "retard", "vermin", "filth", "scumbag", "jerk"]
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "clown fish", "pond scum", "soap scum",
              "stupid simple", "circus clown", "class clown"]
SEED_WEIGHT = 4.0
DEFAULT_COEFFICIENTS = (-3.0, 1.0, 0.5, 2.0)

_FULLWIDTH = {c + 0xFEE0: chr(c) for c in range(0x21, 0x7F)}
_TABLE = {**_FULLWIDTH, **{ord(k): v for k, v in HOMOGLYPHS.items()}}
_SIGNS = "".join(map(re.escape, SUBSTITUTES))
_INSIDE = re.compile(rf"(?<=[^\W\d_])[{_SIGNS}]+(?=[^\W\d_])")
_LEADING = re.compile(rf"(?<![\w@$])[{_SIGNS}](?=[^\W\d_]{{2}})")
_HAS_SIGN = re.compile(f"[{_SIGNS}]")
_WORD = re.compile(r"[^\W_]+")
_SWAP = str.maketrans(SUBSTITUTES)


def fold(text: str) -> str:
    """Lower case, homoglyphs and imitated letters undone."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(_TABLE)
    if _HAS_SIGN.search(t):
        t = _INSIDE.sub(lambda m: m[0].translate(_SWAP), t)
        t = _LEADING.sub(lambda m: m[0].translate(_SWAP), t)
    return t


def folded_words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


@dataclass
class Lexicon:
    """Terms (``word`` or ``stem*``) with weights, exception phrases, coefficients."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    coefficients: tuple[float, ...] = DEFAULT_COEFFICIENTS

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            pattern = " " + term[:-1] if term.endswith("*") else f" {term} "
            a.add_word(pattern, (len(pattern), w))
        for phrase in self.exceptions:
            pattern = " " + " ".join(folded_words(phrase)) + " "
            a.add_word(pattern, (len(pattern), 0.0))
        a.make_automaton()
        return a


def features(words: list[str], automaton) -> tuple[float, float, float]:
    """``(log hits, log summed weight, weight per hundred words)``.

    A word counts once, with its heaviest term; a hit that starts inside an
    exception phrase does not count.
    """
    found: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    if words and len(automaton):
        for end, (length, w) in automaton.iter(" " + " ".join(words) + " "):
            start = end - length + 1
            if w:
                found[start] = max(found.get(start, 0.0), w)
            else:
                excused.append((start, end))
    hits = [w for s, w in found.items() if not any(a <= s < b for a, b in excused)]
    total = sum(hits)
    return (math.log1p(len(hits)), math.log1p(total),
            math.log1p(100.0 * total / (len(words) + 20)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int,
                    max_rows: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``max_rows`` labelled rows outside the held-out fold.

    Those of the smallest hashes; a cut that three times as many labels pass
    comes first, so that the last task of the sort gets no more than that.
    """
    draw = drawn("doc_id", F.lit(17))
    cut = 3.0 * max_rows / max(1, labels.count())
    picked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.col(label).cast("int").alias("y"))
              .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()
                     & (F.pmod(crc_of_id(), F.lit(modulus)) != held_out))
              .where(draw <= cut).orderBy(draw, "doc_id", "y").limit(max_rows)
              .groupBy("doc_id").agg(F.max("y").alias("y")))
    # at most max_rows rows of 12 bytes: the bound makes the broadcast safe
    return id_and_text(docs).join(F.broadcast(picked), "doc_id")


def _words_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: folded word, toxic rows and clean rows that hold it."""
    for b in batches:
        n: dict[str, list[int]] = {}
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
            for w in set(folded_words(text)):
                n.setdefault(w, [0, 0])[1 if y else 0] += 1
        yield pa.RecordBatch.from_pydict({
            "word": pa.array(list(n), pa.string()),
            "toxic": pa.array([v[1] for v in n.values()], pa.int64()),
            "clean": pa.array([v[0] for v in n.values()], pa.int64())})


def learn_terms(sample: DataFrame, n_toxic: int, n_clean: int,
                max_terms: int = MAX_TERMS) -> dict[str, float]:
    """The lexicon's terms and weights from labelled rows."""
    words = (sample.select("text", "y")
             .mapInArrow(_words_kernel, "word string, toxic long, clean long")
             .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    stems = words.select(
        F.explode(F.concat(
            F.array(F.col("word")),
            F.transform(F.filter(F.array(*[F.lit(k) for k in STEM_LENGTHS]),
                                 lambda k: k < F.char_length("word")),
                        lambda k: F.concat(F.substring(F.col("word"), F.lit(1), k), F.lit("*"))))
                  ).alias("term"), "toxic", "clean")
    p = (F.col("toxic") + 0.5) / (n_toxic + 1.0)
    q = (F.col("clean") + 0.5) / (n_clean + 1.0)
    odds = F.log(p / q)
    se = F.sqrt(1.0 / (F.col("toxic") + 0.5) + 1.0 / (F.col("clean") + 0.5))
    rows = (stems.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where(F.col("toxic") >= MIN_SUPPORT)
            .select("term", odds.alias("odds"), (odds / se).alias("z"), "toxic")
            .where((F.col("odds") >= MIN_LOG_ODDS) & (F.col("z") > 3.0))
            .orderBy(F.desc(F.col("odds") * F.log1p("toxic")), F.desc(F.char_length("term")),
                     F.desc("term"))
            .limit(8 * max_terms).collect())
    chosen: dict[str, float] = {}
    for r in rows:
        bare = r["term"].rstrip("*")
        if len(chosen) < max_terms and not any(
                bare.startswith(c) or c.startswith(bare)
                for c in (x.rstrip("*") for x in chosen)):
            chosen[r["term"]] = float(r["odds"])
    return chosen


def _features_kernel(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            f = [features(folded_words(t), a) for t in b.column("text").to_pylist()]
            x = np.array(f, float).reshape(-1, 3)
            yield pa.RecordBatch.from_pydict({
                "y": b.column("y"), **{f"f{i}": pa.array(x[:, i]) for i in range(3)}})
    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first coefficient is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(x.T @ (x * w[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2,
        max_rows: int = MAX_ROWS) -> Lexicon:
    """Learn the lexicon and its coefficients from the rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", modulus, held_out, max_rows)
    n = sample.agg(F.sum((F.col("y") > 0).cast("long")).alias("t"),
                   F.sum((F.col("y") <= 0).cast("long")).alias("c")).first()
    toxic, clean = int(n["t"] or 0), int(n["c"] or 0)
    seed = dict.fromkeys(SEED_WORDS, SEED_WEIGHT)
    if not toxic or not clean:
        return Lexicon(seed)
    learned = learn_terms(sample, toxic, clean)
    covered = [t.rstrip("*") for t in learned]
    weights = {**{w: v for w, v in seed.items() if not any(w.startswith(c) for c in covered)},
               **learned}
    lexicon = Lexicon(weights)
    rows = (sample.select("text", "y").mapInArrow(
        _features_kernel(lexicon), "y int, f0 double, f1 double, f2 double").toPandas())
    x, y = rows[["f0", "f1", "f2"]].to_numpy(float), (rows["y"].to_numpy() > 0).astype(float)
    lexicon.coefficients = tuple(float(v) for v in logistic(x, y))
    return lexicon


def _score_kernel(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        b0, *b = lexicon.coefficients
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                f = features(folded_words(text), a)
                z = b0 + sum(u * v for u, v in zip(b, f, strict=True))
                scores.append(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())})
    return run


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    return id_and_text(docs).mapInArrow(_score_kernel(lexicon), "doc_id long, score double")


def _filter_kernel(lexicon: Lexicon, threshold: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        b0, *b = lexicon.coefficients
        limit = math.log(threshold / (1.0 - threshold))
        for batch in batches:
            keep = []
            for text in batch.column(text_at).to_pylist():
                f = features(folded_words(text or ""), a)
                keep.append(b0 + sum(u * v for u, v in zip(b, f, strict=True)) < limit)
            yield batch.filter(pa.array(keep, pa.bool_()))
    return run


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns, in one scan."""
    return docs.mapInArrow(_filter_kernel(lexicon, threshold, docs.columns.index("text")),
                           docs.schema)
