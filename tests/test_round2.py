"""Ties, codes, keys and headers that earlier tables did not hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regemb.operators import distances, graph, regions, stats, votes


@pytest.mark.parametrize("values", [2, 3])
def test_median_of_tied_distances_equals_numpy(spark, values):
    z = np.random.default_rng(values).integers(0, values, (1500, 1)).astype(float)
    n, got = distances.exact_pair_median(spark, z)
    i, j = np.triu_indices(len(z), 1)
    assert n == len(i) and got == np.median((z[i, 0] - z[j, 0]) ** 2)


def test_codes_compare_as_numbers_and_lookups_are_unique(spark):
    rows = spark.createDataFrame([("01", "00100"), ("02", "7")], "ST string, PUMA string")
    lookup = spark.createDataFrame([("1", "100", "AL_1")], "ST string, PUMA string, region string")
    got = {r["ST"]: r["region"] for r in
           regions.assign_region(rows, lookup, ["ST", "PUMA"]).collect()}
    assert got == {"01": "AL_1", "02": None}
    with pytest.raises(Exception, match="repeats"):
        regions.assign_region(rows, lookup.union(lookup), ["ST", "PUMA"]).collect()


def test_sample_draws_members_not_households(spark):
    rows = spark.range(4000).select((F.col("id") / 4).cast("long").alias("h"),
                                    (F.col("id") % 4).alias("m"), F.lit(1.0).alias("w"))
    got = stats.weighted_sample(rows, "w", 400, key=["h", "m"]).collect()
    assert len({(r["h"], r["m"]) for r in got}) == 400
    assert len({r["h"] for r in got}) > 250


def test_state_files_bind_by_name(spark, tmp_path):
    (tmp_path / "al.csv").write_text("fips,county,candidate,votes\n01001,Autauga,X,5\n")
    (tmp_path / "ga.csv").write_text("candidate,votes,fips,county\nY,7,13001,Appling\n")
    got = {(r["state"], r["fips"], r["candidate"], r["votes"])
           for r in votes.read_state_files(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("al", "01001", "X", 5), ("ga", "13001", "Y", 7)}


def test_hub_component(spark):
    edges = spark.createDataFrame([(f"n{i:04d}", "hub") for i in range(2000)]
                                  + [("p", "q")], "a string, b string")
    got = graph.connected_components(edges).groupBy("component").count().collect()
    assert {(r["component"], r["count"]) for r in got} == {("hub", 2001), ("p", 2)}


def test_logit_binomial_recovers_shares_beyond_4096_columns(spark):
    from pyspark.ml.linalg import SparseVector

    from regemb.operators import regress
    rows = [(f"r{i}", SparseVector(5000, [i % 2], [1.0]), 30 if i % 2 else 80, 100)
            for i in range(20)]
    df = spark.createDataFrame(rows, ["region", "features", "y", "n"])
    model = regress.logit_binomial(df, reg=1e-6)
    got = {r["region"]: r["probability"][1] for r in model.transform(df).collect()}
    assert abs(got["r0"] - 0.8) < 0.01 and abs(got["r1"] - 0.3) < 0.01


def test_logit_binomial_after_an_observed_query(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import Observation

    from regemb.operators import regress
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    df = spark.createDataFrame([("a", Vectors.dense(1.0, 0.0), 80, 100),
                                ("b", Vectors.dense(0.0, 1.0), 30, 100)],
                               ["region", "features", "y", "n"])
    model = regress.logit_binomial(df, reg=1e-6)
    got = {r["region"]: r["probability"][1] for r in model.transform(df).collect()}
    assert seen.get["n"] == 3 and abs(got["a"] - 0.8) < 0.01 and abs(got["b"] - 0.3) < 0.01
