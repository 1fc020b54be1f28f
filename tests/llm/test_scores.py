"""Operators 8 and 10: every score against plain loops over words, signs and tables."""

from __future__ import annotations

import bisect
import math
import random

import pytest

from regemb.llm import quality, toxicity
from regemb.llm.base import table
from tests.conftest import SF_SMALL


def texts(spark):
    rng = random.Random(8)
    rows = [(r["doc_id"], r["text"]) for r in
            table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    alphabet = "ab Zé.!?|,1\n\t日 stupid trash can"
    rows += [(10_000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(120))))
             for i in range(100)]
    return [*rows, (20_000, None), (20_001, ""), (20_002, " \n "), (20_003, "STUPID st*pid 5tupid")]


def plain_measure(text):
    """The features from their names, character by character."""
    if not text:
        return [0.0] * len(quality.FEATURES)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(words)
    spaces = sum(c in " \t\n\x0b\x0c\r" for c in text)
    if not n:
        return [math.log1p(len(text)), 0, 0, 0, 0, 1.0] + [0.0] * (len(quality.FEATURES) - 6)
    upper = sum("A" <= c <= "Z" for c in text)
    lower = sum("a" <= c <= "z" for c in text)
    beyond = sum(ord(c) > 127 for c in text)
    digits = sum("0" <= c <= "9" for c in text)
    marks = sum(c in ".,;:?'\"()-" for c in text)
    shouts, bars = text.count("!"), text.count("|")
    letters = upper + lower + beyond
    other = len(text) - spaces - digits - letters - marks - shouts - bars
    ends = 0
    for i, c in enumerate(text):
        odd = not (c.isalnum() or c == "_" or c.isspace() or c in ".,;:?'\"()-")
        ends += odd and (i + 1 == len(text) or text[i + 1].isspace())
    return [math.log1p(len(text)), math.log1p(n), letters / n, upper / (letters + 1),
            digits / len(text), spaces / len(text), marks / n, other / n, bars / n, shouts / n,
            len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
            1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
            sum(x.rstrip()[-1:] in (".", "?", "!") for x in lines) / max(1, len(lines)),
            sum(w[0].isupper() for w in words) / n, ends / n, math.log1p(max(map(len, words)))]


def test_quality_score_is_the_sum_of_its_tables(spark):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    model = quality.fit(docs, labels)
    rows = texts(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(df, model).collect()}
    for d, text in rows:
        x = plain_measure(text)
        assert quality.measure(text or "") == pytest.approx(x, abs=1e-12), (d, text)
        z = model.intercept
        for v, edges, values in zip(x, model.edges, model.tables, strict=True):
            z += values[bisect.bisect_right(list(edges), v)]
        at = [bisect.bisect_right(list(e), v) for v, e in zip(x, model.pair_edges, strict=True)]
        z += sum(t[at[i], at[j]] for i, j, t in model.pairs)
        assert got[d] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-9)


def plain_hits(words, lexicon):
    """Summed weights and hits: each word by its heaviest term, phrases of exceptions excused."""
    excused = set()
    phrases = [toxicity.folded_words(p) for p in lexicon.exceptions]
    for i in range(len(words)):
        for p in phrases:
            if words[i:i + len(p)] == p:
                excused.update(range(i, i + len(p)))
    hits = []
    for i, w in enumerate(words):
        found = [v for term, v in lexicon.weights.items()
                 if (w.startswith(term[:-1]) if term.endswith("*") else w == term)]
        if found and i not in excused:
            hits.append(max(found))
    return hits


def test_toxicity_score_by_plain_matching(spark):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    lexicon = toxicity.fit(docs, labels)
    rows = texts(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(df, lexicon).collect()}
    some = 0
    for d, text in rows:
        words = toxicity.folded_words(text or "")
        hits = plain_hits(words, lexicon)
        some += bool(hits)
        total = sum(hits)
        b0, b1, b2, b3 = lexicon.coefficients
        z = (b0 + b1 * math.log1p(len(hits)) + b2 * math.log1p(total)
             + b3 * math.log1p(100 * total / (len(words) + 20)))
        assert got[d] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-9)
    assert some > 5
