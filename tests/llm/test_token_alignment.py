"""Operator 13 against a plain pairwise version with the libraries' own tokenizers."""

from __future__ import annotations

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from regemb.llm import queries as Q
from regemb.llm import token_alignment as T
from tests.conftest import SF_SMALL

PATHS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, pair string, block long, n_a string, facts string"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Library:
    """Token ids and byte ranges straight from the libraries."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(
            model_file=public_tokenizers.path("piece_bpe_32k.model"))
        signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in signs]
        self.byte_of = {chr(b): b for b in signs} | {chr(256 + i): b for i, b in enumerate(other)}

    def a_token(self, i):
        return bytes(self.byte_of[c] for c in self.a.id_to_token(i))

    def b_token(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def spans(self, text):
        whole = (" " + text).encode()
        sides = []
        for ids, token in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.a_token),
                           (self.b.encode(text), self.b_token)):
            at, out = 0, []
            for i in ids:
                out.append((i, at, at + len(token(i))))
                at = out[-1][2]
            if b"".join(map(token, ids)) != whole:
                return [], []
            sides.append(out)
        return sides


def brute(rows):
    lib = Library()
    parts, count = [], collections.Counter()
    for doc_id, text in rows:
        a, b = lib.spans(text) if text else ([], [])
        links = [(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e] if len(a) < 400 else None
        if links is None:                      # two pointers for long texts
            links, k = [], 0
            for i, s, e in a:
                while b[k][2] <= s:
                    k += 1
                links += [(i, b[m][0]) for m in range(k, min(k + e - s + 1, len(b)))
                          if b[m][1] < e and s < b[m][2]]
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for end in ends:
            inside = [[str(i) for i, s, _ in side if start <= s < end] for side in (a, b)] \
                if len(ends) < 400 else None
            groups.append((start, end, inside))
            start = end
        if groups and groups[0][2] is None:
            a_at, b_at, done = 0, 0, []
            for s, end, _ in groups:
                left, right = [], []
                while a_at < len(a) and a[a_at][1] < end:
                    left.append(str(a[a_at][0]))
                    a_at += 1
                while b_at < len(b) and b[b_at][1] < end:
                    right.append(str(b[b_at][0]))
                    b_at += 1
                done.append((s, end, [left, right]))
            groups = done
        written = ";".join("|".join(",".join(x) for x in g[2]) for g in groups)
        count.update(set(links))
        parts.append((doc_id, len(a), len(b), len(groups), links,
                      hashlib.sha256(written.encode()).hexdigest() if a else ""))
    highest = collections.Counter()
    for (i, _), n in count.items():
        highest[i] = max(highest[i], n)
    return collections.Counter(
        (d, n_a, n_b, n_g, len(links), sum(count[x] == highest[x[0]] for x in links),
         sum(count[x] for x in links), sha) for d, n_a, n_b, n_g, links, sha in parts)


def got(df):
    return collections.Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in df.collect())


ODD = ["", None, "  ", "a  b", "tab\tand\n\nlines ", "ﬁ é ① naïve", "日本語 ☃ 😀 text", "a▁b", "<s> hi </s>",
       "<|endoftext|> plain", "<0x41>", "x\x00y", "12345 6789", "don't we'll", "ÿ 　z",
       "word " * 3000, "aaaa" * 500, "Привет мир", "é and é", " line", "word one"]


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    alphabet = "ab cdé▁ß\n\t.,!<>|日😀́'0159 the and"
    rows = list(enumerate(ODD))
    rows += [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(80)))) for i in range(200)]
    return rows + [(None, "no id the"), (3, "a  b"), (3, "a  b")]


def test_odd_rows_match_brute_force(spark, odd_rows, monkeypatch):
    for n in (10**9, 300):
        monkeypatch.setattr(T, "BLOCK_BYTES", n)
        monkeypatch.setattr(T, "SLICE_BYTES", n // 3)
        df = spark.createDataFrame([(d, t, "p", 5, "x", "f") for d, t in odd_rows], SCHEMA).repartition(3)
        assert got(T.documents(df, *PATHS)) == brute(odd_rows)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet")
            .select("doc_id", "text").collect()]
    assert got(Q.op13_token_alignment(spark, SF_SMALL)) == brute(rows)


def test_groups_hold_the_same_bytes(spark, odd_rows):
    lib = Library()
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(odd_rows)], "doc_id long, text string")
    seen = collections.defaultdict(dict)
    for r in T.groups(df, *PATHS).collect():
        a = b"".join(map(lib.a_token, r["a_ids"]))
        assert a == b"".join(map(lib.b_token, r["b_ids"])) and a
        seen[r["doc_id"]][r["group"]] = a
    for i, (_, t) in enumerate(odd_rows):
        groups = seen.get(i, {})
        assert sorted(groups) == list(range(len(groups)))
        if groups:
            assert b"".join(groups[k] for k in sorted(groups)) == (" " + t).encode()


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.documents(empty, *PATHS).collect() == []
    assert T.groups(empty, *PATHS).collect() == []


def test_no_broadcast_of_the_pairs(spark):
    df = Q.op13_token_alignment(spark, SF_SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ResolvedHint" not in plan and "broadcast" not in plan
