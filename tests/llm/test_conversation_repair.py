"""Operator 11 against a plain dynamic programme written from the contract."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from regemb.llm import conversation_repair as C
from regemb.llm import queries as Q
from tests.conftest import SF_MID, SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string, kind string, copies int, facts string"
WELL_FORMED = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute(turns):
    """Facts, cost, audit and digest of one conversation's rows."""
    turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2],
                                         hashlib.sha256(r[3].encode()).digest()))
    numbers = [r[1] for r in turns if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    kinds, seen, count = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, _, role, text in turns:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        kind = ("blank" if not last else "duplicate" if (role, text) in seen
                else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
        kinds.append(kind)
        if kind:
            count[kind] += 1
    initials = [r[2][:1] for r in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ())}         # letter before -> cost, audit, lines

    def insert(layer):
        layer = dict(layer)
        for _ in range(3):
            for q, (c, a, lines) in list(layer.items()):
                for role in ("user", "assistant"):
                    to = step.get((q, role[0]))
                    new = (c + 2, a + "I", (*lines, f"{role}:"))
                    if to and (to not in layer or new[:2] < layer[to][:2]):
                        layer[to] = new
        return layer

    for (_, _, role, text), kind in zip(turns, kinds, strict=True):
        after = {}
        for q, (c, a, lines) in insert(best).items():
            options = [(q, (c + 3, a + "D", lines))]
            if kind not in ("blank", "duplicate"):
                extra = kind == "truncated"
                if role and (q, role[0]) in step:
                    options.append((step[q, role[0]], (c + extra, a + "K", (*lines, f"{role}:{text}"))))
                for r in ("user", "assistant"):
                    if (q, r[0]) in step:
                        options.append((step[q, r[0]], (c + 2 + extra, a + "R", (*lines, f"{r}:{text}"))))
            for to, new in options:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = after
    best = insert(best)
    cost, audit, lines = min(best[q] for q in ("", "a") if q in best)
    assert WELL_FORMED.fullmatch("".join(x[0] for x in lines))
    return (gaps, *count.values(), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows, damage=damaged):
    groups = {r[0]: [] for r in rows}
    for r in damage(rows):
        groups[r[0]].append(r)
    return {c: brute(g) for c, g in groups.items()}


def result(df):
    cols = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in cols) for r in rows}


def random_turns(rng, conv, n):
    return [(conv, rng.choice([None, t, t, t, t // 2]),
             rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             rng.choice(["Yes.", "No", " ", None, "a. ", f"text {rng.randrange(n + 1)}!", "end?\n"]))
            for t in range(n)]


@pytest.fixture(scope="module")
def odd_turns():
    rng = random.Random(5)
    rows = [r for c in range(150) for r in random_turns(rng, c, rng.randrange(1, 12))]
    rows += [(None, None, None, None), (None, 1, "user", "x."), (900, 0, "user", "z. " * 20_000)]
    return rows + rng.sample(rows, 60)


def table_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "k", 7, "f") for r in rows], SCHEMA).repartition(parts)


def test_edges_have_one_target_per_letter():
    for code in (0, 1, 2, 3, 4, 9, 10, 11, 12):
        for out in C.row_edges(code).values():
            assert len({piece for _, _, piece in out}) == len(out)


def test_damaged_rows_match_brute_force(spark, odd_turns):
    got = result(C.digests(C.damage(table_of(spark, odd_turns))))
    assert got == expected(odd_turns)


def test_undamaged_rows_and_repaired_text(spark, odd_turns):
    rows = C.as_rows(table_of(spark, odd_turns))
    want = expected(odd_turns, damage=lambda rs: [
        (c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rs])
    assert result(C.digests(rows)) == want
    lines: dict = {}
    for r in sorted(C.repair(rows).collect(), key=lambda r: r["position"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, facts in want.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == facts[-1]


def test_long_conversation_over_many_tasks(spark, monkeypatch):
    """Several segments, several tasks, repeated rows: the same answer as one pass."""
    rng = random.Random(11)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]),
             rng.choice(["Again.", f"number {t}.", f"number {t}", ""])) for t in range(1500)]
    rows += [(0, 0, "user", "a."), (2, 0, "user", "b."), (2, 1, "assistant", "c.")]
    rows += [(3, 4, "user", "same.")] * 700
    plain = {r[0]: [] for r in rows}
    for r in rows:
        plain[r[0]].append(r)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(C.digests(C.as_rows(table_of(spark, rows))))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == {c: brute(g) for c, g in plain.items()}


@pytest.mark.parametrize("seed", range(4))
def test_search_joins_to_the_same_audit(seed):
    """Segments of any size give the audit of the whole."""
    rng = random.Random(seed)
    for _ in range(60):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 9, 10, 11, 12]) for _ in range(rng.randrange(1, 40)))
        whole = C.final_audit(C.read_table(C.solve_whole(codes)))
        size = rng.randrange(1, 6)
        parts = [C.read_table(C.solve_segment(codes[i:i + size])) for i in range(0, len(codes), size)]
        assert C.final_audit(C.join_tables(parts)) == whole


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.digests(C.damage(empty)).collect() == []
    assert C.repair(C.as_rows(empty)).collect() == []


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert result(Q.op11_conversation_repair(spark, sf)) == expected(rows)
