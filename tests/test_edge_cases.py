"""Small in-code frames for the semantic corner cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regemb.functions import recode as R
from regemb.operators import clean, embed, encode, graph, regions, rff
from regemb.operators import stats as st
from regemb.spec import MicrodataSpec

SPEC = MicrodataSpec(name="t", weight="w", real=("x",), discrete=("d",))


def _df(spark, rows, schema="region string, w double, x double, d string"):
    return spark.createDataFrame(rows, schema)


def _values(emb):
    return {(r["region"], r["subset"], r["feature_name"]): r["value"]
            for r in emb.values.collect()}


def test_zero_weight_subset(spark):
    df = _df(spark, [("a", 0.0, 1.0, "p"), ("a", 0.0, 2.0, "q")])
    s = st.compute_stats(df, SPEC, sample_size=0)
    e = embed.linear_embedding(df, s)
    assert all(v == 0.0 for v in _values(e).values())
    assert [r["weight"] for r in e.weights.collect()] == [0.0]


def test_wholly_null_real_encodes_zero(spark):
    df = _df(spark, [("a", 1.0, None, "p"), ("a", 2.0, None, "q")])
    s = st.compute_stats(df, SPEC, sample_size=0)
    assert s.real_params()["x"][0] is None
    assert _values(embed.linear_embedding(df, s))[("a", 0, "x")] == 0.0


def test_zero_spread_real_encodes_zero(spark):
    df = _df(spark, [("a", 1.0, 3.0, "p"), ("a", 2.0, 3.0, "q")])
    s = st.compute_stats(df, SPEC, sample_size=0)
    assert _values(embed.linear_embedding(df, s))[("a", 0, "x")] == 0.0


def test_unseen_level_is_all_zero(spark):
    train = _df(spark, [("a", 1.0, 1.0, "a"), ("a", 1.0, 2.0, "b")])
    s = st.compute_stats(train, SPEC, sample_size=0)
    new = _df(spark, [("r", 1.0, 1.0, "c")])
    vals = _values(embed.linear_embedding(new, s))
    assert not any(k[2].startswith("d_") for k in vals)


def test_null_level_gets_nan_column(spark):
    df = _df(spark, [("a", 1.0, 1.0, "a"), ("a", 3.0, 2.0, None)])
    s = st.compute_stats(df, SPEC, sample_size=0)
    assert s.needs_nan()["d"] is True
    names = [r[1] for r in encode.catalogue_rows(s)]
    assert names == ["x", "d_a", "d_nan"]
    vals = _values(embed.linear_embedding(df, s))
    assert vals[("a", 0, "d_nan")] == pytest.approx(0.75)
    assert vals[("a", 0, "d_a")] == pytest.approx(0.25)


def test_one_row_mean_is_the_row(spark):
    df = _df(spark, [("a", 2.0, 5.0, "z")])
    s = st.compute_stats(df, SPEC, sample_size=0)
    vals = _values(embed.linear_embedding(df, s))
    assert vals == {("a", 0, "x"): 0.0, ("a", 0, "d_z"): 1.0}


def test_null_citizenship_kept_and_text_codes(spark):
    df = spark.createDataFrame([(30.0, None), (30.0, "5"), (30.0, "b"), (10.0, "1")],
                               "AGEP double, CIT string")
    kept = clean.voters_only(df).collect()
    assert sorted([r["CIT"] for r in kept], key=str) == [None, "b"]


def test_household_collision_raises(spark):
    p = spark.createDataFrame([(1, 2)], "SERIALNO int, X int")
    h = spark.createDataFrame([(1, 3)], "SERIALNO int, X int")
    with pytest.raises(clean.SchemaError):
        clean.join_housing(p, h)


def test_schema_check_names_columns(spark):
    spec = MicrodataSpec(name="t", weight="w", real=("x",), discrete=("d",))
    df = spark.createDataFrame([(1.0, 1.0, "a", 5)], "w double, x double, d string, extra int")
    with pytest.raises(clean.SchemaError, match="extra"):
        clean.check_schema(df, spec)
    with pytest.raises(clean.SchemaError, match="d"):
        clean.check_schema(df.drop("d", "extra"), spec)


def test_already_adjusted_left_alone(spark):
    df = spark.createDataFrame([(100.0, 2000000)], "PINCP double, ADJINC_orig long")
    out = clean.adjust(df, "ADJINC", ["PINCP"]).collect()[0]
    assert out["PINCP"] == 100.0
    df2 = spark.createDataFrame([(100.0, 2000000)], "PINCP double, ADJINC long")
    out2 = clean.adjust(df2, "ADJINC", ["PINCP"]).collect()[0]
    assert out2["PINCP"] == 200.0 and out2["ADJINC_orig"] == 2000000


def test_unmapped_place_reported(spark):
    df = spark.createDataFrame([(1, 1), (1, 9), (1, 9)], "ST int, PUMA int")
    lk = spark.createDataFrame([(1, 1, "A")], "ST int, PUMA int, region string")
    a = regions.assign_region(df, lk, ["ST", "PUMA"])
    rep = regions.unmapped_report(a, ["ST", "PUMA"]).collect()
    assert [(r["ST"], r["PUMA"], r["count"]) for r in rep] == [(1, 9, 2)]
    assert regions.mapped_only(a).count() == 1


def test_chain_of_200_edges_is_one_component(spark):
    pairs = [(f"a{i:03d}", f"b{i:03d}") for i in range(100)]
    pairs += [(f"a{i + 1:03d}", f"b{i:03d}") for i in range(99)]
    df = spark.createDataFrame(pairs, "county string, puma string")
    m = graph.bipartite_components(df, "county", "puma")
    assert m.select("component").distinct().count() == 1
    assert m.count() == 200


def test_components_do_not_depend_on_edge_order(spark):
    rs = np.random.default_rng(0)
    pairs = [(f"c{rs.integers(60)}", f"p{rs.integers(60)}") for _ in range(80)]
    a = graph.bipartite_components(spark.createDataFrame(pairs, "c string, p string"), "c", "p")
    b = graph.bipartite_components(spark.createDataFrame(pairs[::-1], "c string, p string"),
                                   "c", "p")
    assert sorted(a.collect()) == sorted(b.collect())
    # brute force: union-find
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for u, v in pairs:
        parent[find("L:" + u)] = find("R:" + v)
    groups = {}
    for n in parent:
        groups.setdefault(find(n), set()).add(n)
    assert a.select("component").distinct().count() == len(groups)


def test_forced_merge_makes_one_region(spark):
    df = spark.createDataFrame([("02-1", "x"), ("02-2", "y"), ("03-1", "z")], "c string, p string")
    forced = {"02": df.where(F.col("c").startswith("02")).select("c")}
    m = graph.bipartite_components(df, "c", "p", forced=forced)
    comps = {r["key"]: r["component"] for r in m.collect()}
    assert comps["02-1"] == comps["02-2"] != comps["03-1"]


def test_component_spanning_states_raises(spark):
    m = spark.createDataFrame([("left", "01-1", "L:01-1", "01"), ("left", "02-1", "L:01-1", "02")],
                              "side string, key string, component string, st string")
    with pytest.raises(graph.ComponentStateError):
        graph.name_regions(m, "st", "00")


def test_old_industry_pair(spark):
    df = spark.createDataFrame([(None, "23")], "naicsp07 string, naicsp02 string")
    got = df.select(R.industry_sector(R.first_present("naicsp07", "naicsp02"))).first()[0]
    assert got == "Construction"


def test_unknown_industry_raises(spark):
    df = spark.createDataFrame([("ZZ1",)], "n string")
    with pytest.raises(Exception):
        df.select(R.industry_sector("n")).collect()


def test_multi_subset_conditional_equals_single_runs(spark):
    rs = np.random.default_rng(1)
    rows = [("r" + str(rs.integers(2)), float(rs.integers(1, 5)), float(rs.normal()),
             ["a", "b", "c"][rs.integers(3)]) for _ in range(60)]
    df = _df(spark, rows)
    s = st.compute_stats(df, SPEC, sample_size=0)
    f = rff.gaussian_freqs(1, 3, 1.0, seed=2)
    subsets = ["x > 0", "d <> 'a'"]
    both = rff.real_rff_embedding(df, s, ["x"], f, subsets=subsets, condition="d")
    got = {(r["region"], r["subset"], r["feature_name"]): r["value"]
           for r in both.values.collect()}
    for i, p in enumerate(subsets):
        one = rff.real_rff_embedding(df, s, ["x"], f, subsets=[p], condition="d")
        for r in one.values.collect():
            assert got[(r["region"], i, r["feature_name"])] == pytest.approx(r["value"])


def test_orthogonal_frequencies():
    w = rff.orthogonal_freqs(4, 8, bandwidth=2.0, seed=0)
    assert w.shape == (4, 8)
    block = w[:, :4] / np.linalg.norm(w[:, :4], axis=0)
    assert np.allclose(block.T @ block, np.eye(4), atol=1e-10)
    assert rff.orthogonal_freqs(1, 5, 1.0, seed=0).shape == (1, 5)


def test_median_heuristic_matches_brute_force(spark):
    from regemb.operators import distances
    rs = np.random.default_rng(3)
    Z = rs.normal(size=(150, 3))
    C = rs.integers(-1, 3, size=(150, 2))
    n, med = distances.exact_pair_median(spark, Z, C)
    d = []
    for i in range(150):
        for j in range(i + 1, 150):
            dd = float(((Z[i] - Z[j]) ** 2).sum())
            for k in range(2):
                if C[i, k] != C[j, k]:
                    dd += int(C[i, k] >= 0) + int(C[j, k] >= 0)
            d.append(dd)
    assert n == len(d)
    assert med == pytest.approx(float(np.median(d)), rel=1e-12)


def test_rff_matches_dense_numpy(spark):
    rs = np.random.default_rng(4)
    rows = [("r" + str(rs.integers(3)), float(rs.integers(1, 4)), float(rs.normal()),
             ["a", "b", None][rs.integers(3)]) for _ in range(80)]
    df = _df(spark, rows)
    s = st.compute_stats(df, SPEC, sample_size=0)
    W = rff.gaussian_freqs(4, 5, 1.0, seed=9)  # rows: x, d_a, d_b, d_nan
    got = {(r["region"], r["pos"]): r["value"]
           for r in rff.rff_embedding(df, s, freqs=W).values.collect()}
    m, sd = s.real_params()["x"]
    cols = ["a", "b", "nan"]
    for reg in {r[0] for r in rows}:
        X, w = [], []
        for r in rows:
            if r[0] != reg:
                continue
            oh = [1.0 if (r[3] or "nan") == c else 0.0 for c in cols]
            X.append([(r[2] - m) / sd] + oh)
            w.append(r[1])
        A = np.array(X) @ W
        feats = np.c_[np.sin(A), np.cos(A)]
        want = (np.array(w) @ feats) / (sum(w) * math.sqrt(5))
        for j, v in enumerate(want):
            assert got[(reg, j)] == pytest.approx(v, abs=1e-12)


def test_custom_featurizer_matches_linear_mean(spark):
    rs = np.random.default_rng(6)
    rows = [("r" + str(rs.integers(3)), float(rs.integers(1, 4)), float(rs.normal()),
             ["a", "b"][rs.integers(2)]) for _ in range(50)]
    df = _df(spark, rows)
    s = st.compute_stats(df, SPEC, sample_size=0)

    def feats(Z, idx):
        # first real and its square, plus "has an active level"
        return np.c_[Z[:, 0], Z[:, 0] ** 2, (idx[:, 0] >= 0).astype(float)]

    got = {(r["region"], r["pos"]): r["value"]
           for r in rff.custom_embedding(df, s, feats, 3, "mine").values.collect()}
    lin = {(r["region"], r["feature_name"]): r["value"]
           for r in embed.linear_embedding(df, s).values.collect()}
    for reg in {r[0] for r in rows}:
        assert got[(reg, 0)] == pytest.approx(lin[(reg, "x")], abs=1e-12)
        assert got[(reg, 2)] == pytest.approx(1.0)


def test_interactions_roll_up(spark):
    from regemb.operators import rollup
    rows = [("AL_1", 1.0, 1.0, "a"), ("AL_2", 3.0, 2.0, "b"), ("AK_1", 2.0, 0.0, None)]
    df = _df(spark, rows)
    spec = MicrodataSpec(name="t", weight="w", real=("x",), discrete=("d", "e"))
    df = df.withColumn("e", F.lit("z"))
    s = st.compute_stats(df, spec, sample_size=0)
    inter = embed.interaction_embedding(df, s, [("d", "e")])
    names = [r["feature_name"] for r in
             embed.pair_catalogue(s, [("d", "e")]).orderBy("pos").collect()]
    assert names == ["d_e_a_z", "d_e_b_z", "d_e_nan_z"]
    got = {(r["region"], r["pos"], r["feature_name"]): r["value"]
           for r in rollup.state_rollup(inter).values.collect()}
    assert got[("AL", 0, "d_e_a_z")] == pytest.approx(0.25)
    assert got[("AL", 1, "d_e_b_z")] == pytest.approx(0.75)
    assert got[("AK", 2, "d_e_nan_z")] == pytest.approx(1.0)


def test_linear_embedding_matches_pandas_brute_force(spark):
    import pandas as pd
    rs = np.random.default_rng(11)
    n = 400
    pdf = pd.DataFrame({
        "region": rs.choice(["a", "b", "c", "d"], n),
        "w": rs.integers(0, 5, n).astype(float),
        "x": np.where(rs.random(n) < 0.2, np.nan, rs.normal(3, 2, n)),
        "d": rs.choice(["p", "q", "r", None], n)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "region string, w double, x double, d string")
    s = st.compute_stats(df, SPEC, sample_size=0)
    subsets = ["x > 3", "d = 'q' OR d IS NULL"]
    got = {(r["region"], r["subset"], r["feature_name"]): r["value"]
           for r in embed.linear_embedding(df, s, subsets=subsets).values.collect()}
    m, sd = pdf["x"].mean(), pdf["x"].std(ddof=0)
    z = ((pdf["x"] - m) / sd).fillna(0.0)
    masks = [(pdf["x"] > 3).to_numpy(), ((pdf["d"] == "q") | pdf["d"].isna()).to_numpy()]
    for i, mask in enumerate(masks):
        for reg in "abcd":
            sel = mask & (pdf["region"] == reg).to_numpy()
            w = pdf["w"][sel]
            tw = w.sum()
            if not sel.any():
                continue
            exp_x = float((w * z[sel]).sum() / tw) if tw else 0.0
            assert got[(reg, i, "x")] == pytest.approx(exp_x, abs=1e-12)
            for lv in ["p", "q", "r", "nan"]:
                hit = (pdf["d"][sel].fillna("nan") == lv).to_numpy()
                exp = float(w[hit].sum() / tw) if tw else 0.0
                assert got.get((reg, i, f"d_{lv}"), 0.0) == pytest.approx(exp, abs=1e-12)


def test_rff_thermometer_matches_dense_numpy(spark):
    rs = np.random.default_rng(12)
    rows = [("r" + str(rs.integers(2)), float(rs.integers(1, 4)), float(rs.normal()),
             ["a", "b", "c", None][rs.integers(4)]) for _ in range(60)]
    df = _df(spark, rows)
    s = st.compute_stats(df, SPEC, sample_size=0)
    W = rff.gaussian_freqs(5, 3, 1.0, seed=13)  # rows: x, d_a, d_b, d_c, d_nan
    got = {(r["region"], r["pos"]): r["value"] for r in
           rff.rff_embedding(df, s, freqs=W, ordered={"d": ["a", "b", "c"]}).values.collect()}
    m, sd = s.real_params()["x"]
    for reg in {r[0] for r in rows}:
        X, w = [], []
        for r in rows:
            if r[0] != reg:
                continue
            k = {"a": 1, "b": 2, "c": 3}.get(r[3], 0)
            X.append([(r[2] - m) / sd] + [1.0 if j < k else 0.0 for j in range(3)] + [0.0])
            w.append(r[1])
        A = np.array(X) @ W
        want = (np.array(w) @ np.c_[np.sin(A), np.cos(A)]) / (sum(w) * math.sqrt(3))
        for j, v in enumerate(want):
            assert got[(reg, j)] == pytest.approx(v, abs=1e-12)


def test_rff_inner_products_approach_kernel_mean(spark):
    rs = np.random.default_rng(21)
    rows = [(["a", "b"][i % 2], float(rs.integers(1, 4)), float(rs.normal(i % 2, 1.0)),
             ["p", "q"][rs.integers(2)]) for i in range(80)]
    df = _df(spark, rows)
    s = st.compute_stats(df, SPEC, sample_size=0)
    bw, D = 1.5, 4096
    W = rff.gaussian_freqs(3, D, bw, seed=5)  # rows: x, d_p, d_q
    vals = rff.rff_embedding(df, s, freqs=W).values.collect()
    emb = {reg: np.zeros(2 * D) for reg in "ab"}
    for r in vals:
        emb[r["region"]][r["pos"]] = r["value"]
    m, sd = s.real_params()["x"]

    def enc(r):
        return np.array([(r[2] - m) / sd, r[3] == "p", r[3] == "q"], dtype=float)
    A = [(enc(r), r[1]) for r in rows if r[0] == "a"]
    B = [(enc(r), r[1]) for r in rows if r[0] == "b"]
    num = sum(wa * wb * math.exp(-((xa - xb) ** 2).sum() / (2 * bw * bw))
              for xa, wa in A for xb, wb in B)
    den = sum(w for _, w in A) * sum(w for _, w in B)
    assert float(emb["a"] @ emb["b"]) == pytest.approx(num / den, abs=0.03)


def test_rings_without_area(spark):
    from regemb.operators import geo
    ring = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame(
        [("a", [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), ("a", [(5.0, 5.0)]),
         ("b", [(1.0, 1.0), (3.0, 5.0)])], f"region string, polygon {ring}")
    got = {r["region"]: (r["lon"], r["lat"], r["area"]) for r in geo.region_centroids(df).collect()}
    assert got == {"a": (1.0, 1.0, 4.0), "b": (2.0, 3.0, 0.0)}


def test_empty_subset_weighs_nothing_and_others_unaffected(spark):
    df = _df(spark, [("a", 1.0, 1.0, "p"), ("a", 3.0, 2.0, "q")])
    s = st.compute_stats(df, SPEC, sample_size=0)
    e = embed.linear_embedding(df, s, subsets=["x > 100", "TRUE"])
    subs = {r["subset"]: r["weight"] for r in e.weights.collect()}
    assert subs == {0: 0.0, 1: 4.0}
    assert subs == {r["subset"]: r["weight"] for r in embed.region_weights(
        df, "w", subsets=["x > 100", "TRUE"]).collect()}
    alone = embed.linear_embedding(df, s, subsets=["TRUE"])
    a = {(r["feature_name"]): r["value"] for r in e.values.collect()}
    b = {(r["feature_name"]): r["value"] for r in alone.values.collect()}
    assert a == pytest.approx(b)
