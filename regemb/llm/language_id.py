"""Language identification of mixed texts (operator 12).

* **Script ranges narrow the candidates.**  A word's script is read off its
  first letter; languages whose training text does not use that script are no
  candidates for the word (if none uses it, all stay).
* **Per-word scores.**  A word scores, for each language, the log probabilities
  of its letter n-grams (:data:`ORDERS`, with word ends) and of the word itself.
  N-grams are hashed into a table of fixed size, so all distinct words of a
  batch are scored by a few array operations.
* **Viterbi with a switching penalty.**  The path of languages over a text's
  words maximises the summed scores minus :data:`SWITCH` per change, which
  labels spans.  The language whose spans hold most letters is the text's; the
  score is its share of the letters.

The table is learned from about :data:`SAMPLE` texts per language (smallest
hash of the row; a documented bound), cut first by a threshold from exact
counts so that no task receives more than a few times the rows wanted.  It has
at most :data:`CELLS` cells (slots times languages).  Scoring reads every word
of every text.

Null text and text without a letter are ``und`` with score 0, as is everything
when there was nothing to learn from.  Letter runs longer than
:data:`RUN` are read in pieces of that length.  Equal texts score alike,
extra columns are ignored, ties go to the language that sorts first, an empty
table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regemb.llm.base import crc_of_id, stored, text_of

SAMPLE = 2_000           # texts per language that the table is learned from
CELLS = 2_000_000        # slots times languages in the table
ORDERS = (1, 2, 3, 4)
MIN_COUNT = 2            # times that a slot occurs in the sample
SMOOTH = 0.5
RUN = 24
SWITCH = 10.0            # nats that a change of language costs
BEHIND = 12.0            # nats that a language without the word's script is behind the candidates
MIN_SCRIPT = 0.01        # share of a language's words that makes a script its own
MEMORY = 1_200_000       # words times languages whose scores a task remembers
BATCH_CELLS = 2_000_000  # words times languages that are labelled at a time
NEW_WORDS = 16_000       # words that are scored at a time
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]{1,%d}" % RUN)

# First code points of the Unicode blocks of each script, ascending.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"),
    (0x0780, "Thaana"), (0x07C0, "Nko"), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Cherokee"), (0x1400, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x2D00, "Georgian"), (0x2D30, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"), (0x3040, "Hiragana"),
    (0x30A0, "Katakana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0x31F0, "Katakana"), (0x3200, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"),
    (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAB30, "Latin"),
    (0xAB70, "Cherokee"), (0xABC0, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Katakana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"),
    (0x323B0, "Other"),
]
_STARTS = [s for s, _ in SCRIPTS]


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def words_of(text: str) -> list[str]:
    """Lower-case letter runs; signs that only look like letters to ``re`` are dropped later."""
    return _LETTERS.findall(text.lower())


def slots_of(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of words, and where each word begins.

    The words lie end to end with a mark on either side; row i of the slots
    belongs to place i and has a column per order, and one for the word itself
    at its first place.  ``1 << bits`` means that no n-gram is there.
    """
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    text = "".join(f"^{w}$" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    place = np.arange(n) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place
    slots = np.full((n, len(ORDERS) + 1), 1 << bits, np.int64)
    prime, mix = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)

    def slot(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * mix
        return ((h ^ (h >> np.uint64(32))) * mix >> np.uint64(64 - bits)).astype(np.int64)

    for column, order in enumerate(ORDERS):
        h = np.full(n, order, np.uint64)
        for j in range(order):
            h[:n - j] = h[:n - j] * prime + codes[j:]
        there = left >= order
        if order == 1:
            there &= (place > 0) & (left > 1)
        slots[there, column] = slot(h[there])
    powers = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(RUN + 2)], np.uint64)
    whole = np.add.reduceat(codes * powers[place], starts) + np.uint64(0xABCD)
    slots[starts, len(ORDERS)] = slot(whole)
    return slots, starts


# ----------------------------------------------------------------- learning

def training_rows(docs: DataFrame, modulus: int, held_out: int, sample: int = SAMPLE) -> DataFrame:
    """``(lang, text)`` of about ``sample`` rows of each language outside the fold.

    A row's draw is a hash in [0, 1).  The counts of the languages (the driver
    knows every language, as the model does) give a cut that about three
    times the rows wanted pass; of those the draw of rank ``sample`` is the
    language's last.  Only ids and draws are sorted, texts are not moved.
    Rows that tie with the last one are all learned from.
    """
    draw: Column = F.shiftrightunsigned(F.xxhash64("doc_id", "lang", "text", F.lit(12)), 11) \
        / float(1 << 53)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
                        F.col("lang").cast("string").alias("lang"))
                .where(F.col("lang").isNotNull()
                       & (F.pmod(crc_of_id(), F.lit(modulus)) != held_out))
                .withColumn("draw", draw))
    spark = docs.sparkSession

    def by_lang(values: dict[str, float], name: str) -> DataFrame:
        # one row per language the model will hold: small enough to broadcast
        return F.broadcast(spark.createDataFrame(list(values.items()), f"lang string, {name} double"))

    counts = {r["lang"]: 3.0 * sample / r["count"] for r in rows.groupBy("lang").count().collect()}
    order = Window.partitionBy("lang").orderBy("draw")
    last = (rows.select("lang", "draw").join(by_lang(counts, "cut"), "lang").where("draw <= cut")
                .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)
                .groupBy("lang").agg(F.max("draw").alias("last")).collect())
    lasts = by_lang({r["lang"]: r["last"] for r in last}, "last")
    return rows.join(lasts, "lang").where("draw <= last").select("lang", "text")


def _words_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            n.update((lang, w) for w in words_of(text) if w.isalpha())
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([k[0] for k in n], pa.string()),
            "word": pa.array([k[1] for k in n], pa.string()),
            "n": pa.array(list(n.values()), pa.int64())})


def _slots_kernel(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch and language: how often each slot of each order occurs."""
        for b in batches:
            if not b.num_rows:
                continue
            lang = b.column("lang").dictionary_encode()
            of = lang.indices.to_numpy()
            slots, starts = slots_of(b.column("word").to_pylist(), bits)
            word = np.repeat(np.arange(b.num_rows), np.diff(np.append(starts, len(slots))))
            n = b.column("n").to_numpy()[word]
            for column in range(slots.shape[1]):
                on = slots[:, column] < 1 << bits
                key = of[word[on]].astype(np.int64) << bits | slots[on, column]
                distinct, where = np.unique(key, return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array(np.full(len(distinct), column), pa.int32()),
                    "slot": pa.array(distinct & ((1 << bits) - 1), pa.int32()),
                    "lang": lang.dictionary.take(pa.array(distinct >> bits)),
                    "n": pa.array(np.bincount(where, weights=n[on]).astype(np.int64))})
    return run


@dataclass
class Model:
    """Languages, log probabilities by order and slot, and the languages of each script.

    ``table`` has ``(orders + 1) << bits`` rows: the slots of each order, then
    those of whole words.
    """

    langs: list[str]
    bits: int = 0
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    scripts: dict[str, list[int]] = field(default_factory=dict)
    switch: float = SWITCH

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Word scores of one task, each distinct word scored once."""

    def __init__(self, model: Model):
        self.model, self.n = model, len(model.langs)
        # a row of zeros after the slots of each order stands for no n-gram
        slots, langs = 1 << model.bits, max(self.n, 1)
        self.tables = [np.vstack([model.table[k * slots:(k + 1) * slots], np.zeros((1, langs), np.float32)])
                       for k in range(len(ORDERS) + 1)] if self.n else []
        self.candidates = np.ones((len(model.scripts) + 1, max(self.n, 1)), bool)
        self.script = {}
        for i, (script, langs) in enumerate(model.scripts.items()):
            self.script[script] = i
            self.candidates[i] = False
            self.candidates[i, langs] = True
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((1024, max(self.n, 1)), np.float32)
        self.lengths = np.zeros(1024, np.int64)
        self.held = 0

    def learn(self, words: list[str]) -> None:
        """Score words that were not met before, all at once."""
        slots, starts = slots_of(words, self.model.bits)
        places = sum(t[slots[:, k]] for k, t in enumerate(self.tables))
        scores = np.add.reduceat(places, starts, axis=0) / len(ORDERS)
        allowed = self.candidates[[self.script.get(script_of(w[0]), -1) for w in words]]
        floor = np.where(allowed, scores, np.inf).min(axis=1) - BEHIND
        scores = np.where(allowed, scores, floor[:, None])
        scores -= scores.max(axis=1, keepdims=True)
        end = self.held + len(words)
        if end > len(self.scores):
            grown = max(end, 2 * len(self.scores))
            self.scores = np.resize(self.scores, (grown, self.scores.shape[1]))
            self.lengths = np.resize(self.lengths, grown)
        self.scores[self.held:end] = scores
        self.lengths[self.held:end] = [len(w) for w in words]
        self.ids.update(zip(words, range(self.held, end), strict=True))
        self.held = end

    def score(self, word: str) -> np.ndarray:
        """Score of a word for every language."""
        return self.scores[self.word_ids([[word]])[0][0]]

    def word_ids(self, texts: list[list[str]]) -> list[list[int]]:
        """Numbers of the words of texts; what has a sign that is no letter is -1."""
        ids = self.ids
        new = {w for words in texts for w in words if w not in ids}
        ids.update((w, -1) for w in new if not w.isalpha())
        letters = [w for w in new if w.isalpha()]
        for i in range(0, len(letters), NEW_WORDS):
            self.learn(letters[i:i + NEW_WORDS])
        return [list(map(ids.__getitem__, words)) for words in texts]


def words_with_letters(text: str) -> list[str]:
    """Words of a text; a run with other signs among its letters is read letter by letter run."""
    out = []
    for w in words_of(text):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word of many texts at once.

    ``scores`` are the words' rows, text after text; text i has ``sizes[i] > 0``
    words from ``starts[i]`` on.  Step t works on the texts that have more
    than t words.
    """
    n, langs = scores.shape
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0])
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    came = np.zeros((n, langs), np.int16)
    everyone = np.arange(langs, dtype=np.int16)
    value = scores[starts].copy()
    for t in range(1, longest):
        k = active[t]
        v, at = value[:k], starts[:k] + t
        top = v.argmax(axis=1)
        moved = v[np.arange(k), top] - switch
        change = v < moved[:, None]
        came[at] = np.where(change, top[:, None].astype(np.int16), everyone)
        value[:k] = np.where(change, moved[:, None], v) + scores[at]
    labels = np.zeros(n, np.int16)
    state = value.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        labels[at] = state[:k]
        if t:
            state[:k] = came[at, state[:k]]
    return labels


def label_texts(scorer: Scorer, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every text: language number and letters of each of its words."""
    out: list = [None] * len(texts)
    none = np.zeros(0, np.int16)

    def label(first: int, words: list[list[str]]) -> None:
        if len(scorer.ids) * scorer.n > MEMORY:
            scorer.forget()
        numbers = scorer.word_ids(words)
        for i, x in enumerate(numbers):
            if -1 in x:
                numbers[i] = scorer.word_ids([words_with_letters(texts[first + i])])[0]
        with_words = [i for i, x in enumerate(numbers) if x]
        for i, x in enumerate(numbers):
            if not x:
                out[first + i] = none, none
        if not with_words:
            return
        ids = np.concatenate([np.array(numbers[i]) for i in with_words])
        sizes = np.array([len(numbers[i]) for i in with_words])
        starts = np.cumsum(sizes) - sizes
        labels = viterbi(scorer.scores[ids], starts, sizes, scorer.model.switch)
        letters = scorer.lengths[ids]
        for i, s, k in zip(with_words, starts, sizes, strict=True):
            out[first + i] = labels[s:s + k], letters[s:s + k]

    first, held, cells = 0, [], 0
    for i, text in enumerate(texts):
        words = words_of(text)
        held.append(words)
        cells += (len(words) + 1) * scorer.n
        if cells >= BATCH_CELLS or i + 1 == len(texts):
            label(first, held)
            first, held, cells = i + 1, [], 0
    return out


def predict(scorer: Scorer, texts: list[str]) -> list[tuple[str, float]]:
    """Language and score of every text."""
    langs = scorer.model.langs
    if not langs:
        return [(UNKNOWN, 0.0)] * len(texts)
    out = []
    for labels, letters in label_texts(scorer, texts):
        if not len(labels):
            out.append((UNKNOWN, 0.0))
            continue
        held = np.bincount(labels, weights=letters, minlength=len(langs))
        best = int(held.argmax())
        out.append((langs[best], float(held[best] / held.sum())))
    return out


def fit(docs: DataFrame, modulus: int = 3, held_out: int = 1, sample: int = SAMPLE) -> Model:
    """Learn the languages of ``docs`` from the rows outside the held-out fold."""
    words = (training_rows(docs, modulus, held_out, sample)
             .mapInArrow(_words_kernel, "lang string, word string, n long")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    words = stored(words, "words")
    langs = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return Model([])
    bits = max(10, int(np.log2(CELLS / (len(langs) * (len(ORDERS) + 1)))))
    # as many rows as the table has cells at most
    rows = (words.mapInArrow(_slots_kernel(bits), "kind int, slot int, lang string, n long")
            .groupBy("kind", "slot", "lang").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(((len(ORDERS) + 1) << bits, len(langs)))
    number = {lang: i for i, lang in enumerate(langs)}
    at = rows.column("kind").to_numpy().astype(np.int64) << bits | rows.column("slot").to_numpy()
    counts[at, [number[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    table = np.zeros(counts.shape, np.float32)
    for k in range(len(ORDERS) + 1):
        part = slice(k << bits, (k + 1) << bits)
        c = counts[part] + SMOOTH
        table[part] = np.log(c / c.sum(axis=0))
    table[counts.sum(axis=1) < MIN_COUNT] = 0
    letters: dict[str, Counter] = defaultdict(Counter)
    for r in (words.groupBy("lang", F.substring("word", 1, 1).alias("letter"))
                   .agg(F.sum("n").alias("n")).collect()):
        letters[r["lang"]][script_of(r["letter"])] += r["n"]
    scripts: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        total = sum(letters[lang].values())
        for script, n in letters[lang].items():
            if n >= MIN_SCRIPT * total:
                scripts.setdefault(script, []).append(i)
    return Model(langs, bits, table, scripts)


# ----------------------------------------------------------------- scoring

def _predict_kernel(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            out = predict(scorer, b.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"),
                "lang_pred": pa.array([x[0] for x in out], pa.string()),
                "score": pa.array([x[1] for x in out], pa.float64())})
    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
                .mapInArrow(_predict_kernel(model), "doc_id long, lang_pred string, score double"))


def spans_of(scorer: Scorer, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Runs of words of one language as ``(first word, words, language)``."""
    if not scorer.model.langs:
        return [[] for _ in texts]
    out = []
    for labels, _ in label_texts(scorer, texts):
        edges = np.flatnonzero(np.diff(labels)) + 1
        bounds = [0, *edges.tolist(), len(labels)] if len(labels) else [0]
        out.append([(a, b - a, scorer.model.langs[labels[a]])
                    for a, b in zip(bounds, bounds[1:], strict=False)])
    return out


def _spans_kernel(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            rows = [(d, *s) for d, spans in zip(
                b.column("doc_id").to_pylist(), spans_of(scorer, b.column("text").to_pylist()),
                strict=True) for s in spans]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(cols[0], pa.int64()), "first_word": pa.array(cols[1], pa.int64()),
                "n_words": pa.array(cols[2], pa.int64()), "lang": pa.array(cols[3], pa.string())})
    return run


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, first_word, n_words, lang`` of every span of every text."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
                .mapInArrow(_spans_kernel(model),
                            "doc_id long, first_word long, n_words long, lang string"))
