"""Operator 12: held-out accuracy, spans against a plain Viterbi, odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from regemb.llm import language_id as L
from regemb.llm import queries as Q
from tests.conftest import SF_MID

SCHEMA = "doc_id long, text string, lang string, rank long, draw string, n string"
EN = "the cat and the dog are in the house with a friend of the family"
DE = "der Hund und die Katze sind mit einem Freund der Familie im Haus"
RU = "кошка и собака живут в доме вместе с другом семьи"
UK = "кішка і собака живуть у будинку разом із другом сім'ї"
EL = "η γάτα και ο σκύλος είναι στο σπίτι με έναν φίλο"


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(240):
        lang, text = [("en", EN), ("de", DE), ("ru", RU), ("uk", UK), ("el", EL)][i % 5]
        words = text.split()
        rows.append((i, " ".join(words[i % 4:] + words[:i % 4]), lang, 1, "d", "n"))
    rows += [(1000, None, "en", 1, "d", "n"), (1001, "", "en", 1, "d", "n"), (1002, "12 ²³ !?", "de", 1, "d", "n"),
             (None, EN, None, 1, "d", "n"), (1003, EN, None, 1, "d", "n"), (5, EN, "en", 1, "d", "n")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs)


def test_scripts_narrow_candidates(model):
    assert model.langs == ["de", "el", "en", "ru", "uk"]
    assert [model.langs[i] for i in model.scripts["Cyrillic"]] == ["ru", "uk"]
    assert [model.langs[i] for i in model.scripts["Greek"]] == ["el"]
    s = model.scorer().score("γάτα")
    assert s.argmax() == 1 and np.delete(s, 1).max() <= s[1] - L.BEHIND


def test_fold_is_not_learned_from(spark, docs):
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    held = [r["text"] for r in L.training_rows(docs, 3, 1).collect()]
    allowed = [r["text"] or "" for r in rows
               if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    assert sorted(held) == sorted(allowed)


def test_sample_is_bounded_per_language(docs):
    n = L.training_rows(docs, 3, 1, sample=7).groupBy("lang").count().collect()
    assert {r["count"] for r in n} == {7}


def test_odd_rows(spark, docs, model):
    out = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    assert L.identify(docs, model).count() == docs.count()
    for i in (1000, 1001, 1002):
        assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
    assert out[None]["lang_pred"] == out[1003]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out.values())


def plain_viterbi(scores, switch):
    n, k = scores.shape
    value, back = list(scores[0]), []
    for t in range(1, n):
        best = [max(range(k), key=lambda p: (value[p] - (switch if p != q else 0), p == q, -p))
                for q in range(k)]
        back.append(best)
        value = [value[p] - (switch if p != q else 0) + scores[t][q] for q, p in enumerate(best)]
    path = [max(range(k), key=lambda q: (value[q], -q))]
    for best in reversed(back):
        path.append(best[path[-1]])
    return value, path[::-1]


def test_viterbi_matches_a_plain_one():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 7, 30, 2, 30, 4])
    starts = np.cumsum(sizes) - sizes
    scores = rng.normal(0, 3, (sizes.sum(), 4))
    labels = L.viterbi(scores, starts, sizes, 2.0)
    for s, n in zip(starts, sizes, strict=True):
        _, path = plain_viterbi(scores[s:s + n], 2.0)
        assert labels[s:s + n].tolist() == path


def test_mixed_text_has_spans(spark, model):
    text = f"{EN} {EN} {RU} {RU} {DE} {DE}"
    df = spark.createDataFrame([(1, text), (2, None), (3, "x²y the")], "doc_id long, text string")
    rows = L.spans(df, model).where("doc_id = 1").orderBy("first_word").collect()
    assert [r["lang"] for r in rows] == ["en", "ru", "de"]
    assert rows[-1]["first_word"] + rows[-1]["n_words"] == len(L.words_with_letters(text))
    assert [r["first_word"] for r in rows] == [0, 2 * len(EN.split()), 2 * len((EN + " " + RU).split())]


def test_slots_depend_on_the_word_alone():
    words = ["haus", "x", "hausboot", "кот", "haus"]
    slots, starts = L.slots_of(words, 12)
    bounds = [*starts.tolist(), len(slots)]
    for i, w in enumerate(words):
        alone, _ = L.slots_of([w], 12)
        assert (slots[bounds[i]:bounds[i + 1]] == alone).all()
        there = (alone < 1 << 12).sum(axis=0)
        n = len(w)
        assert there.tolist() == [n, n + 1, n, max(n - 1, 0), 1]


def test_batches_do_not_change_results(model, monkeypatch):
    texts = [EN, "", f"{RU} {DE} {DE}", UK * 30, "!", DE]
    whole = L.predict(model.scorer(), texts)
    monkeypatch.setattr(L, "BATCH_CELLS", 1)
    monkeypatch.setattr(L, "MEMORY", 1)
    assert L.predict(model.scorer(), texts) == whole
    assert [L.predict(model.scorer(), [t])[0] for t in texts] == whole


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, EN, None), (2, None, None)], "doc_id long, text string, lang string")
    model = L.fit(df)
    assert model.langs == []
    assert {tuple(r) for r in L.identify(df, model).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert L.spans(df, model).collect() == []
    assert L.identify(df.limit(0), L.fit(df.limit(0))).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    rows = (Q.op12_language_id(spark, SF_MID).where("held_out").join(docs, "doc_id")
            .where("lang is not null").collect())
    assert len(rows) > 200
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert right / len(rows) > 0.98, right / len(rows)
