"""The training-data operators against brute force, on awkward small tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from regemb.llm import (exact_dedup, license_scan, mixing, ngram_join, packing, quality, shingles,
                        spotsigs, suffix_dedup, token_count, toxicity)
from regemb.llm import queries as Q
from regemb.llm.base import crc_of_id, id_and_text, table
from tests.conftest import SF_MID, SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long"
PASSAGE = "a passage of more than fifty bytes that several documents share word for word. "
LONG = " ".join(f"word{i % 97} the cat{i % 89} and of" for i in range(4000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s1", 1, "k", 1),
    (2, "Alpha  beta gamma\tdelta epsilon zeta eta theta iota kappa", "en", "s1", 1, "k", 1),
    (3, None, None, None, None, None, None),
    (4, "", "en", "", 0, "", 0),
    (5, "   \n\t ", "en", "s2", 0, "", 0),
    (6, PASSAGE + "tail one", "en", "s2", 1, "x", 2),
    (7, "head two " + PASSAGE + PASSAGE, "de", None, 1, "x", 2),
    (7, "another row of the same id " + PASSAGE, "de", "s3", 1, "x", 2),
    (8, LONG, "en", "s3", 1, "x", 2),
    (9, LONG + " end", "en", "s3", 1, "x", 2),
    (None, "no id " + PASSAGE, "en", "s4", 1, "x", 2),
    (10, "!!! ???", "en", "s4", 1, "x", 2),
    (10, "!!! ???", "en", "s4", 1, "x", 2),
    (11, "Élève ΑΣ don't 12 'sx <|endoftext|> naïve ﬁ", "fr", "s5", 1, "x", 2),
    (12, "aaaa" * 60, "en", "s5", 1, "x", 2),
    (13, "aaaa" * 40 + "b", "en", "s5", 1, "x", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def multiset(rows):
    return collections.Counter(rows)


# --- 1 -------------------------------------------------------------------------


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text.lower())
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_classes(rows):
    """``(class of each row, links of each row)``."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] == sets[b] or (either and both >= 0.8 * either - 1e-9):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(rows))], links


def brute_links(rows):
    of, links = brute_classes(rows)
    names = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        names[of[i]].append(d)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in names.items()}
    return multiset((rows[i][0], name[of[i]], links[i]) for i in range(len(rows)))


def test_ngram_join_odd_rows(odd):
    got = ngram_join.classes(odd).collect()
    assert multiset((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == \
        brute_links(texts_of(odd))


def test_ngram_join_table(spark):
    docs = table(spark, SF_SMALL, "documents")
    got = ngram_join.classes(docs).collect()
    assert multiset((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == \
        brute_links(texts_of(docs))


def test_ngram_join_blocks(spark, monkeypatch):
    """A group larger than a block loses no link."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.classes(docs).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 49)}


def test_ngram_join_empty(empty):
    assert ngram_join.classes(empty).collect() == []
    assert ngram_join.dedup(empty).collect() == []


def test_ngram_dedup_keeps_columns(odd):
    kept = ngram_join.dedup(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 9 not in ids and 8 in ids


def test_ngram_dedup_decides_by_row(spark):
    """Null ids, shared ids and a user's own __id do not keep copies."""
    words = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(None, words, 77), (None, words, 78), (3, other, 79), (3, other + " more", 80),
            (3, "quite another text of some words", 81), (None, other, 82)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int")
    got = sorted((r["doc_id"] or 0, r["text"], r["__id"]) for r in ngram_join.dedup(df).collect())
    assert [(d, t[:2]) for d, t, _ in got] == [(0, "w0"), (3, "qu"), (3, "v0")]
    assert {x for _, _, x in got} <= {77, 78, 79, 80, 81}
    kept = exact_dedup.dedup(df.withColumn("__sha", F.lit("mine")))
    assert kept.columns == ["doc_id", "text", "__id", "__sha"]
    assert {r["__sha"] for r in kept.collect()} == {"mine"}
    assert sorted(r["__id"] for r in kept.where("doc_id = 3").collect()) == [79, 80, 81]


def test_pruning_limits_follow_the_posterior():
    from math import comb
    for n, m in ngram_join.fewest_matches(0.8, 1e-4, 80, 16):
        def posterior(k, n=n):
            return sum(comb(n + 1, i) * 0.8 ** i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert posterior(m) >= 1e-4 and (m == 0 or posterior(m - 1) < 1e-4)


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 62, 400, np.uint64)
    a = np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 100, np.uint64)]))
    b = np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 100, np.uint64)]))
    sig = shingles.MinHasher(2000).signatures([a, b])
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.05


# --- 2 -------------------------------------------------------------------------


def test_spotsigs_edits(spark, odd):
    for docs in (odd, table(spark, SF_SMALL, "documents")):
        rows = texts_of(docs)
        low = -(1 << 63)
        ordered = sorted(rows, key=lambda r: (low if r[0] is None else r[0], r[1]))
        want = []
        for i, (d, t) in enumerate(ordered):
            follow, half = ordered[i - 1][1], len(t) // 2
            want.append((d, len(t), t[:len(t) - half] + follow[:half]))
        got = spotsigs.edited_and_next(docs).select("doc_id", "n_chars", "edited").collect()
        assert multiset((r["doc_id"], r["n_chars"], r["edited"]) for r in got) == multiset(want)


def test_spotsigs_chains(spark):
    one = spark.createDataFrame([(1, "The cat and the dog run. Of mice")], "doc_id long, text string")
    want = {"^ cat dog run", "the cat dog run", "and dog run mice", "the dog run mice", "of mice"}
    got = spotsigs.with_signatures(one, "text", "s").first()["s"]
    hashes = {r[0] for r in spark.createDataFrame([("¤" + w,) for w in want], "w string")
              .select(F.xxhash64(F.substring("w", 2, 99))).collect()}
    assert set(got) == hashes


def test_spotsigs_span_texts_without_anchors(spark):
    """A change anywhere in a text without anchors shows; half a change leaves about half."""
    plain = [f"слово{i}" for i in range(100)]
    mixed = ["The", *plain[:40], "and", *plain[40:], "of"]
    zeros = ["0"] * 100
    half = [*plain[:50], *(f"иное{i}" for i in range(50))]
    moved = ["ново", *plain[:30], "ещё", *plain[30:]]
    rows = [(0, "plain", plain), (1, "half", half), (2, "moved", moved), (3, "mixed", mixed),
            (4, "zeros", zeros)]
    for name, words in (("plain", plain), ("mixed", mixed), ("zeros", zeros)):
        rows += [(10 + i, f"{name}-{i}", [*words[:i], "x" * 9, *words[i + 1:]])
                 for i, w in enumerate(words) if w not in ("The", "and", "of")]
    df = spark.createDataFrame([(d, n, " ".join(w)) for d, n, w in rows],
                               "doc_id long, name string, text string")
    sets = {r["name"]: set(r["s"]) for r in spotsigs.with_signatures(df, "text", "s").collect()}
    for name, s in sets.items():
        if "-" in name:
            assert s != sets[name.split("-")[0]], name
    def like(a, b):
        return len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.2 < like("plain", "half") < 0.6
    assert like("plain", "moved") > 0.6
    assert all(like("plain", f"plain-{i}") > 0.7 for i in range(3, 100))


def test_spotsigs_long_run(spark):
    text = " ".join(f"w{i % 5003}" for i in range(300_000))
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(spotsigs.with_signatures(one, "text", "s").first()["s"]) > 500


def test_spotsigs_likeness_and_pairs(odd):
    rows = spotsigs.with_signatures(id_and_text(odd), "text", "s").select("doc_id", "s").collect()
    by_set = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        by_set.setdefault(tuple(r["s"]), r["doc_id"])
    sets = [(d, set(s)) for s, d in by_set.items() if d is not None]
    want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(sets) for b, y in sets[:i]
            if x and y and len(x & y) >= 0.8 * len(x | y)}
    _, pairs = spotsigs.similar(odd.where("doc_id is not null"))
    assert {(r["class_a"], r["class_b"]) for r in pairs.collect()} == want


def test_spotsigs_equal_texts(spark):
    rows = Q.op2_spotsigs(spark, SF_SMALL).collect()
    texts = dict(texts_of(table(spark, SF_SMALL, "documents")))
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[texts[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r["near_edited"] for r in rows]) > 0.25 > np.mean([r["near_next"] for r in rows])


def test_spotsigs_empty(empty):
    assert spotsigs.edited_and_next(empty).collect() == []


# --- 3 -------------------------------------------------------------------------


def check_packing(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    rows = [r.asDict() for r in packing.pack(
        docs, path, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()]
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    want = collections.Counter()
    for d, t in texts_of(docs):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 2048):
            part = ids[s:s + 2048]
            want[(d, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert want == multiset((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
                            for r in rows)
    return windows


def test_packing_odd_rows(odd):
    check_packing(odd)


def test_packing_table(spark):
    windows = check_packing(table(spark, SF_SMALL, "documents"))
    used = [sum(n for _, n in w) for w in windows.values()]
    assert sum(used) > 0.97 * 2048 * len(used)


def test_packing_empty(empty):
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken")).collect() == []


def test_shortest_pack_first():
    patterns = packing.shortest_pack_first({6: 2, 5: 1, 4: 1, 2: 3}, 10)
    placed = collections.Counter()
    for times, lengths in patterns:
        assert sum(lengths) <= 10
        placed.update({n: times * lengths.count(n) for n in set(lengths)})
    assert placed == {6: 2, 5: 1, 4: 1, 2: 3}
    # 4 goes to the emptiest pack that takes it: the one that holds the 5
    assert any(lengths[:2] == [5, 4] for _, lengths in patterns)


# --- 4 -------------------------------------------------------------------------


def brute_targets(sizes, weights):
    fixed, x = np.zeros(len(sizes), bool), np.zeros(len(sizes))
    for _ in range(len(sizes) + 1):
        left = sizes.sum() - 3 * sizes[fixed].sum()
        x[fixed] = 3 * sizes[fixed]
        if not fixed.all():
            x[~fixed] = left * weights[~fixed] / weights[~fixed].sum()
        fixed |= x > 3 * sizes
    return np.minimum(x, 3 * sizes)


def test_targets_and_apportionment():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 8))
        sizes = rng.integers(1, 100, n)
        weights = np.array([mixing.WEIGHTS[i % 3] for i in range(n)])
        assert np.allclose(mixing.targets(sizes, weights), brute_targets(sizes, weights))
        w, caps, seats = rng.integers(0, 50, n), rng.integers(0, 20, n), int(rng.integers(0, 60))
        want, room = np.zeros(n, int), np.where(w > 0, caps, 0)
        for _ in range(min(seats, room.sum())):
            want[np.argmax(np.where(want < room, w / (2 * want + 1), -1))] += 1
        assert (mixing.sainte_lague(w, seats, caps) == want).all()


def check_mix(docs):
    plan = mixing.plan(docs).withColumn("taken", mixing.taken_words(F.col("spans"))).toPandas()
    rows = texts_of(docs)
    assert sorted(plan["size"]) == sorted(
        len(re.findall(r"[^\x20\x09-\x0d]+", t)) for _, t in rows)
    assert (plan.taken <= 3 * plan["size"]).all()
    by = plan.groupby("source", dropna=False).agg(
        target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    keys = sorted(by.index, key=lambda s: (s is None or s != s, "" if s != s or s is None else s))
    by = by.loc[keys]
    weights = np.array([mixing.WEIGHTS[i % 3] for i in range(len(by))])
    assert np.allclose(by.target, brute_targets(by["size"].to_numpy(float), weights))
    assert (abs(by.taken - by.target) <= np.maximum(0.03 * by.target, 1.0)).all()
    again = mixing.plan(docs.repartition(5)).withColumn(
        "taken", mixing.taken_words(F.col("spans"))).toPandas()
    assert multiset(zip(plan.doc_id.fillna(-1), plan.taken, strict=True)) == \
        multiset(zip(again.doc_id.fillna(-1), again.taken, strict=True))
    return plan


def test_mixing_small_sources(spark):
    """A table of a few words has a mix, and every small source comes near its target."""
    two = spark.createDataFrame([(1, "one two", "a"), (2, "three four", "b")],
                                "doc_id long, text string, source string")
    assert check_mix(two).taken.sum() == 4
    many = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i:02d}") for i in range(40)],
                                 "doc_id long, text string, source string")
    check_mix(many)


def test_mixing_ties_by_text(spark):
    """Rows of one id and size but other texts are streamed in one order."""
    rows = [(1, f"{a} x y z", "a") for a in "abcdefghij"] + [(2, "p q", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    def mixed(d):
        return multiset(r["text"] for r in mixing.mix(d).collect())
    assert mixed(df.repartition(1)) == mixed(df.repartition(7)) == mixed(df.orderBy(F.desc("text")))


def test_mixing_odd_rows(odd):
    check_mix(odd)


def test_mixing_texts(spark):
    docs = table(spark, SF_SMALL, "documents")
    plan = check_mix(docs)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.withColumn("w", F.regexp_count("text", F.lit(mixing.WORD))) \
               .groupBy("doc_id").agg(F.sum("w").alias("w")).collect()
    assert {r["doc_id"]: r["w"] for r in got} == \
        {d: t for d, t in zip(plan.doc_id, plan.taken, strict=True) if t}


def test_mixing_empty(empty):
    assert mixing.plan(empty).collect() == [] and mixing.mix(empty).collect() == []


# --- 5 -------------------------------------------------------------------------


def test_license_scan(spark, empty):
    notice = "Licensed under the Apache License, Version 2.0."
    docs = spark.createDataFrame(
        [(1, f"some text\n{notice}\nmore"), (2, "Released under the MIT License."), (3, None),
         (None, "Licensed under CC BY-NC 4.0."), (4, "Please read the license of the car"),
         (5, ""), (1, f"some text\n{notice}\nmore"), (6, LONG + "\n" + notice)],
        "doc_id long, text string")
    got = license_scan.scan(docs, license_scan.Classifier(spark, docs)).where("confirmed").collect()
    assert multiset((r["doc_id"], r["line_no"], r["family"]) for r in got) == multiset(
        [(1, 1, "apache-2.0")] * 2 + [(2, 0, "mit"), (None, 0, "cc-by-nc"), (6, 1, "apache-2.0")])
    none = license_scan.scan(empty, license_scan.Classifier(spark, empty))
    assert none.collect() == []


def test_license_scan_wrapped_notices(spark):
    """Notices wrapped in comments, two in a row too, count once each, with their lines."""
    import textwrap
    rows, want = [], []
    for d, (family, width, lead) in enumerate([
            (f, w, p) for f in ("mit", "gpl", "lgpl", "bsd") for w in (40, 70, 80)
            for p in ("", " * ", "# ")]):
        notice = max(license_scan.TEMPLATES[family], key=len)
        body = textwrap.wrap(notice + ".", width, initial_indent=lead, subsequent_indent=lead)
        rows.append((d, "\n".join(["/* some file of the project", *body, *body, lead, "code"])))
        n = len(body)
        want += [(d, 1, n, family), (d, 1 + n, 2 * n, family)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.scan(docs, license_scan.Classifier(spark, docs)).where("confirmed").collect()
    assert multiset((r["doc_id"], r["line_no"], r["last_line"], r["family"]) for r in got) == \
        multiset(want)


def test_license_scan_long_lines(spark):
    """Every notice of a line has its row, however long the line is."""
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"] + ["version"]

    def prose(n):
        return " ".join(rng.choice(vocabulary, n))
    parts = [license_scan.TEMPLATES[f][-2] + "." for f in ("apache-2.0", "mit", "bsd", "lgpl")]
    rows = [(1, f"{parts[0]} {parts[1]}"), (2, f"{prose(90)} {parts[2]}"),
            (3, " ".join(prose(1500) + " " + x for x in parts) + " " + prose(900)),
            (4, "version " + prose(5000)), (5, prose(5000) + "\n" + prose(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows = license_scan.scan(docs, license_scan.Classifier(spark, docs)).collect()
    assert multiset((r["doc_id"], r["line_no"], r["family"]) for r in rows if r["confirmed"]) == \
        multiset([(1, 0, "apache-2.0"), (1, 0, "mit"), (2, 0, "bsd"), (3, 0, "apache-2.0"),
                  (3, 0, "mit"), (3, 0, "bsd"), (3, 0, "lgpl")])
    assert [r["family"] for r in rows if r["doc_id"] == 4] == ["unknown"]


def test_license_scan_rejects_other_licences(spark):
    """Notices that differ from a template by the words that name a licence are not confirmed."""
    wrong = ["licensed under the Eclipse Public License, version 2.0", "Licensed under CC BY-ND 4.0",
             "Licensed under CC BY-NC-SA 4.0", "licensed under the terms of the Zlib license",
             "Licensed under the Educational Community License, Version 2.0",
             "This work is licensed under the GNU Affero General Public License, version 3",
             "Licensed under the Frobnicate License, Version 2.0"]
    right = [("apache-2.0", "Licensed under the Apache License, Version 2.0"),
             ("cc-by", "Licensed under CC BY 4.0"), ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
             ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1"),
             ("gpl", "This work is licensed under the GNU General Public License, version 3"),
             ("mit", "This software is licensed under the terms of the MIT license")]
    rows = [(i, f"Some words before.\n{t}\nand after.") for i, t in enumerate(wrong)]
    rows += [(100 + i, f"Some words before.\n{t}\nand after.") for i, (_, t) in enumerate(right)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.scan(docs, license_scan.Classifier(spark, docs)).where("confirmed").collect()
    assert {(r["doc_id"], r["family"]) for r in got} == {
        (100 + i, f) for i, (f, _) in enumerate(right)}


def test_license_calibration_uses_unseen_templates():
    rows = license_scan.training_paragraphs()
    held = {(f, t) for f, t, h in rows if h}
    seen = {(f, t) for f, t, h in rows if not h}
    whole = {" ".join(license_scan.words_of(t)) for texts in license_scan.TEMPLATES.values()
             for t in texts}
    kept_back = {t for _, t in held} & whole
    assert len(kept_back) >= 4 and not kept_back & {t for _, t in seen}
    assert {f for f, _ in held} >= {"unknown", "mit", "gpl", "apache-2.0", "bsd"}
    assert {f for f, _ in seen} == set(license_scan.FAMILIES)


def test_license_sample_takes_any_part_of_a_line(spark):
    lines = [(i, " ".join(f"w{k}" for k in range(1000))+ f" end{i}") for i in range(40)]
    df = spark.createDataFrame([*lines, (99, "short, line")], "doc_id long, line string")
    got = {r["doc_id"]: r["x"] for r in
           df.select("doc_id", license_scan.one_window("line").alias("x")).collect()}
    assert got.pop(99) == "short, line"
    assert all(32 < len(x.split()) <= 64 for x in got.values())
    assert len({x.split()[0] for x in got.values()}) > 10


def test_license_cues_cover_templates():
    cues = license_scan.cue_words()
    for texts in license_scan.TEMPLATES.values():
        for text in texts:
            w = license_scan.words_of(text)
            pairs = {(w[i], w[i + 1]) for i in range(len(w) - 1)}
            free = sum(not cues & set(p) for p in pairs)
            assert free < license_scan.MIN_TEMPLATE * len(pairs)


# --- 6 -------------------------------------------------------------------------


def brute_dedup(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t)].append((d, t))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        for d, t in members:
            out.append((d, keep[0], len(members), d == keep[0] and len(t) == len(keep[1]),
                        hashlib.sha256(norm.encode()).hexdigest()))
    return multiset(out)


@pytest.mark.parametrize("capacity", [2, 200_000])
def test_exact_dedup(spark, odd, capacity):
    for docs in (odd, table(spark, SF_SMALL, "documents")):
        got = exact_dedup.classes(docs, capacity).collect()
        assert multiset((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
                        for r in got) == brute_dedup(texts_of(docs))


def test_exact_dedup_rows(odd, empty):
    kept = exact_dedup.dedup(odd)
    norms = [re.sub(r"[\x20\x09-\x0d]", "", t) for _, t in texts_of(odd)]
    assert kept.columns == odd.columns and kept.count() == len(set(norms))
    assert exact_dedup.classes(empty).collect() == [] and exact_dedup.dedup(empty).collect() == []


def test_directory_doubles_and_splits_only_overfull():
    slots = exact_dedup.grow_directory({0: 9, 1: 9, 4: 1, 7: 1}, 3, 10)
    assert len(slots) == 8
    assert slots[0] == (3, 0) and slots[1] == (3, 1) and slots[4] == slots[7] == (1, 1)


# --- 7 -------------------------------------------------------------------------


def test_token_count(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    for docs in (odd, table(spark, SF_SMALL, "documents")):
        got = token_count.count_tokens(docs, path).collect()
        want = [(d, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids))
                for d, t in texts_of(docs)]
        assert multiset((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == multiset(want)
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_count.count_tokens(empty, path).collect() == []


def test_token_count_random_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    counter = token_count.Counter(public_tokenizers.path("word_bpe_49k.json"))
    alphabet = st.characters(blacklist_categories=("Cs", "Cn", "Co"))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet, max_size=40) | st.sampled_from(
        ["don't", "I'VE", "<|endoftext|>", "ΑΣ", "İ", "12ab", "  ", "é"]), max_size=6))
    def same(parts):
        text = " ".join(parts)
        want = len(counter.library.encode(text, add_special_tokens=False).ids)
        assert counter.count([text]) == [want]
    same()


# --- 8, 10 ----------------------------------------------------------------------


def held_out(spark, scored, label, modulus, fold):
    labels = table(spark, SF_MID, "labels")
    rows = scored.join(labels, "doc_id").where(F.pmod(crc_of_id(), F.lit(modulus)) == fold)
    return rows.select("score", label).toPandas()


def test_quality_held_out(spark):
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    model = quality.fit(docs, labels)
    rows = held_out(spark, quality.score_documents(docs, model), "quality", 3, 1)
    assert ((rows.score >= 0.5) == (rows.quality == 1)).mean() > 0.95


def test_quality_odd_rows(odd, empty):
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit(odd, labels)
    rows = quality.score_documents(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.fit(empty, labels.limit(0))
    assert none is None and quality.score_documents(empty, none).collect() == []
    assert {r["score"] for r in quality.score_documents(odd, None).collect()} == {0.5}


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x, y)
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    lexicon = toxicity.fit(docs, labels)
    rows = held_out(spark, toxicity.score_documents(docs, lexicon), "toxic", 4, 2)
    assert ((rows.score >= toxicity.THRESHOLD) == (rows.toxic == 1)).mean() > 0.9


def test_toxicity_folding_and_exceptions():
    assert toxicity.folded_words("An 1d10t, a m0r0n, сlоwn$ in 2024 $$$") == \
        ["an", "idiot", "a", "moron", "clown", "in", "2024"]
    a = toxicity.Lexicon(dict.fromkeys(["trash", "idiot*"], 2.0)).automaton()
    words = toxicity.folded_words
    assert toxicity.features(words("put it in the trash can"), a)[0] == 0
    assert toxicity.features(words("you trash"), a)[0] > 0
    assert toxicity.features(words("IDI0TS!"), a)[0] > 0
    assert toxicity.features(words("videoidiots"), a)[0] == 0


def test_toxicity_odd_rows(odd, empty):
    labels = odd.select("doc_id", F.lit(0).alias("toxic"))
    lexicon = toxicity.fit(odd, labels)
    assert len(toxicity.score_documents(odd, lexicon).collect()) == len(ROWS)
    kept = toxicity.drop_toxic(odd, lexicon)
    assert kept.columns == odd.columns and kept.count() == len(ROWS)
    assert toxicity.score_documents(empty, toxicity.fit(empty, labels.limit(0))).collect() == []


# --- 9 -------------------------------------------------------------------------


def brute_repeats(rows):
    low = -(1 << 63)
    raw = [(low if d is None else d, t.encode()) for d, t in rows]
    first = {}
    for d, t in raw:
        for s in range(len(t) - 49):
            w = t[s:s + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - 49):
            if first[t[s:s + 50]] < d:
                gone[s:s + 50] = True
        gone = gone[:len(t)]
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        n_runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((None if d == low else d, len(t), int(gone.sum()), n_runs,
                    hashlib.sha256(kept).hexdigest()))
    return multiset(out)


@pytest.mark.parametrize("group_bytes", [200, suffix_dedup.GROUP_BYTES])
def test_suffix_dedup(spark, odd, group_bytes):
    for docs in (odd, table(spark, SF_SMALL, "documents")):
        got = suffix_dedup.repeats(docs, group_bytes).collect()
        assert multiset((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                        for r in got) == brute_repeats(texts_of(docs))


def test_suffix_dedup_slices(spark, odd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    pieces = list(suffix_dedup.slices([(0, b"x" * 2000), (1, b"y")], 700))
    assert b"".join(p[:700] for g in pieces for t, _, p in g if t == 0)[:1400] == b"x" * 1400
    assert {(t, o) for g in pieces for t, o, _ in g} == {(0, 0), (0, 700), (0, 1400), (1, 0)}


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.repeats(empty).collect() == []


@pytest.mark.parametrize("letters", [2, 4, 256])
def test_two_stage_order(letters):
    rng = np.random.default_rng(letters)
    data = rng.integers(0, letters, 700).astype(np.uint8)
    data[100:300] = data[400:600]
    raw = data.tobytes()
    order = suffix_dedup.two_stage_order(data)
    assert sorted(order.tolist()) == list(range(len(raw)))
    assert all(raw[a:a + 50] <= raw[b:b + 50] for a, b in zip(order, order[1:], strict=False))
    runs = np.zeros(300, np.uint8)
    runs[150] = 1
    assert sorted(suffix_dedup.two_stage_order(runs).tolist()) == list(range(300))


# --- pipeline --------------------------------------------------------------------


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_pipeline_stages(spark):
    """Every stage against plain Python on its own input."""
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing",
                                        "packing"]
    from regemb.llm.base import stored
    docs = table(spark, SF_SMALL, "documents")
    columns, inputs, outputs = docs.columns, {}, {}
    for name, stage in P.STAGES:
        inputs[name] = docs
        docs = stored(stage(spark, docs, SF_SMALL), f"test-{name}")
        outputs[name] = docs
        if name != "packing":
            assert docs.columns == columns

    lexicon = toxicity.fit(inputs["toxicity"], table(spark, SF_SMALL, "labels"))
    b0, *b = lexicon.coefficients
    automaton = lexicon.automaton()

    def rejected(text):
        f = toxicity.features(toxicity.folded_words(text or ""), automaton)
        z = b0 + sum(u * v for u, v in zip(b, f, strict=True))
        return 1 / (1 + np.exp(-z)) >= toxicity.THRESHOLD
    rows = rows_of(inputs["toxicity"])
    assert multiset(rows_of(outputs["toxicity"])) == multiset(r for r in rows if not rejected(r[1]))

    best = {}
    for r in rows_of(inputs["exact_dedup"]):
        norm = re.sub(r"[\x20\x09-\x0d]", "", r[1] or "")
        rank = (-len(r[1] or ""), r[0])
        if norm not in best or rank < best[norm][0]:
            best[norm] = rank, r
    assert multiset(rows_of(outputs["exact_dedup"])) == multiset(r for _, r in best.values())

    rows = rows_of(inputs["ngram_jaccard"])
    of, _ = brute_classes([(r[0], r[1] or "") for r in rows])
    first = {}
    for c, r in zip(of, rows, strict=True):
        if c not in first or r[0] < first[c][0]:
            first[c] = r
    assert multiset(rows_of(outputs["ngram_jaccard"])) == multiset(first.values())

    check_mix(inputs["mixing"])
    texts = {r[0]: re.findall(r"[^\x20\x09-\x0d]+", r[1] or "") for r in rows_of(inputs["mixing"])}
    for d, t, _ in rows_of(outputs["mixing"]):
        words, part = texts[d], re.findall(r"[^\x20\x09-\x0d]+", t)
        assert part and any(words[i:i + len(part)] == part
                            for i in range(len(words) - len(part) + 1))

    fast = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = collections.Counter()
    for d, t, _ in rows_of(inputs["packing"]):
        want[d] += len(fast.encode(t or ""))
    packed = outputs["packing"].collect()
    got, ends = collections.Counter(), collections.defaultdict(list)
    for r in packed:
        got[r["doc_id"]] += r["length"]
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in ends.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_pipeline_empty(spark, tmp_path):
    import corpus_pipeline as P
    for name in ("documents", "labels"):
        table(spark, SF_SMALL, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in names if re.match(r"op\d+_", q)} == \
        set(range(1, 14))


def test_suffix_dedup_rows_without_ids_do_not_share_keys(spark):
    """Rows without an id are one document, below all others, but join each by itself."""
    rows = [(None, PASSAGE + "first"), (None, PASSAGE + "second"), (5, "x " + PASSAGE), (6, PASSAGE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_removed"]) for r in suffix_dedup.repeats(df).collect())
    n = len(PASSAGE)
    assert got == collections.Counter([(None, 0), (None, 0), (5, n), (6, n)])


def test_merge_marks_equals_merge_text_by_text():
    rng = np.random.default_rng(2)
    doc, check = rng.integers(0, 4, 200), rng.integers(0, 2, 200)
    start = rng.integers(0, 100, 200)
    end = start + rng.integers(1, 9, 200)
    d, c, s, e = suffix_dedup.merge_marks(doc, check, start, end)
    got = [tuple(map(int, x)) for x in zip(d, c, s, e)]
    want = []
    for key in sorted(set(zip(doc.tolist(), check.tolist()))):
        on = (doc == key[0]) & (check == key[1])
        want += [(*key, *map(int, x)) for x in
                 suffix_dedup.merge(np.column_stack([start[on], end[on]]))]
    assert got == want
    none = np.zeros(0, np.int64)
    assert len(suffix_dedup.merge_marks(none, none, none, none)[0]) == 0
