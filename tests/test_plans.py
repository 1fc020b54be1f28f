"""End to end: CSV microdata -> sort -> featurize -> merge -> export."""

import dataclasses
import os

import pytest
from pyspark.sql import functions as F

from regemb.operators import embed
from regemb.operators import stats as st
from regemb.plans import featurize as FZ
from regemb.plans import merge as MG
from regemb.plans.sort import sort_by_region
from regemb.plans.standin import STANDIN, person, region_lookup, superregion_lookup
from regemb.sources import microdata, sinks
from tests.conftest import SF_SMALL

SPEC = dataclasses.replace(STANDIN, adjust={"adjinc": ("l_tax",)})


@pytest.fixture(scope="module")
def sorted_data(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("plans"))
    raw = person(spark, SF_SMALL, with_region=False).drop("batch")
    raw.write.option("header", True).csv(f"{base}/raw_csv")
    df = microdata.read_csv(spark, f"{base}/raw_csv", SPEC)
    lk = region_lookup(spark, SF_SMALL).withColumn("st", F.col("st").cast("string"))
    res = sort_by_region(df, SPEC, lk, ["st"], out_path=f"{base}/by_region",
                         stats_path=f"{base}/stats", voters_only=False, sample_size=200)
    return base, res


def test_partitioned_output(spark, sorted_data):
    base, res = sorted_data
    dirs = [d for d in os.listdir(f"{base}/by_region") if d.startswith("region=")]
    assert len(dirs) == 25
    back = microdata.read_parquet(spark, f"{base}/by_region")
    assert back.count() == res.data.count()
    assert res.unmapped.count() == 0


def test_stats_roundtrip_and_adjustment(spark, sorted_data):
    base, res = sorted_data
    loaded = sinks.load_stats(spark, f"{base}/stats", SPEC)
    assert loaded.n_total() == res.stats.n_total()
    assert loaded.levels() == res.stats.levels()
    assert loaded.region_type == "puma_county"
    assert "adjinc_orig" in res.data.columns
    assert loaded.sample.count() == 200


def test_featurize_merge_export(spark, sorted_data):
    base, res = sorted_data
    data = microdata.read_parquet(spark, f"{base}/by_region")
    stats = sinks.load_stats(spark, f"{base}/stats", SPEC)
    out = FZ.featurize(data, stats, rff_config=FZ.RFFConfig(n_freqs=8, seed=1),
                       extras_config=FZ.ExtrasConfig(reals=["l_extendedprice", "l_tax"],
                                                     discretes=["l_returnflag", "l_linestatus"],
                                                     one_n_freqs=4, pair_n_freqs=4))
    lin, rf = out["lin"], out["rff"]
    # shares of each discrete feature sum to one per region
    sums = (lin.values.where(F.col("feature_id") == "l_linestatus")
            .groupBy("region").agg(F.sum("value").alias("s")).collect())
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in sums)
    # roll-up of regions equals the direct super-region embedding
    mp = superregion_lookup(spark, SF_SMALL)
    rolled = MG.merge_features({"lin": lin}, "superregion", mp)["lin"]
    direct = embed.linear_embedding(
        data.join(mp, "region").drop("region").withColumnRenamed("merged_region", "region"),
        stats)
    a = {(r["region"], r["pos"]): r["value"] for r in rolled.values.collect()}
    b = {(r["region"], r["pos"]): r["value"] for r in direct.values.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)
    # sin^2 + cos^2 of the mean features is at most 1/D per frequency pair
    v = {(r["region"], r["pos"]): r["value"] for r in rf.values.collect()}
    for (reg, p), x in v.items():
        if p < 8:
            assert x * x + v[(reg, p + 8)] ** 2 <= 1 / 8 + 1e-12
    # 2 reals, 1 pair, 2 x 2 conditional blocks (levels 3 and 2), 1 pair of levels (3 x 2)
    width = 2 * 8 + 8 + 2 * (8 * 3 + 8 * 2) + 6
    assert out["extra"].values.count() == 25 * width
    rolled_all = MG.merge_features(out, "superregion", mp)
    assert rolled_all["extra"].values.count() == 5 * width
    # exports
    names = [r["feature_name"] for r in lin.values.select("feature_name").distinct().collect()]
    wide = sinks.export_wide(lin, sorted(names), f"{base}/export_linear.csv")
    assert wide.count() == 25 and len(wide.columns) == len(names) + 1
    w = MG.weight_counts(lin, f"{base}/weights.csv")
    assert w.columns == ["region", "total_wt"]
    back = spark.read.option("header", True).csv(f"{base}/weights.csv")
    assert back.count() == 25
    sinks.save_embedding(lin, f"{base}/emb")
    with pytest.raises(Exception):
        sinks.save_embedding(lin, f"{base}/emb")
    again = sinks.load_embedding(spark, f"{base}/emb")
    assert again.values.count() == lin.values.count()


def test_weight_scaling_invariance(spark):
    p = person(spark, SF_SMALL)
    s = st.compute_stats(p, STANDIN, sample_size=0)
    a = embed.linear_embedding(p, s).values
    p2 = p.withColumn("l_quantity", F.col("l_quantity") * 7.0)
    b = embed.linear_embedding(p2, s).values
    da = {(r["region"], r["pos"]): r["value"] for r in a.collect()}
    db = {(r["region"], r["pos"]): r["value"] for r in b.collect()}
    assert da.keys() == db.keys() and all(abs(da[k] - db[k]) < 1e-9 for k in da)


def test_partition_count_invariance(spark):
    p = person(spark, SF_SMALL)
    s = st.compute_stats(p, STANDIN, sample_size=0)
    a = embed.linear_embedding(p, s).values
    b = embed.linear_embedding(p.repartition(3), s).values
    da = {(r["region"], r["pos"]): r["value"] for r in a.collect()}
    db = {(r["region"], r["pos"]): r["value"] for r in b.collect()}
    assert all(abs(da[k] - db[k]) < 1e-9 for k in da)


def test_hot_region_written_in_parallel(spark, scratch):
    """A region with a third of all rows is split across writer tasks/files."""
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(
            F.concat(F.lit("R"), (F.col("id") % 50).cast("string"))).alias("region"),
        F.col("id").cast("double").alias("x")).repartition(8)
    sinks.write_partitioned(df, f"{scratch}/hot", max_records_per_file=2000)
    files = [f for f in os.listdir(f"{scratch}/hot/region=HOT") if f.endswith(".parquet")]
    assert len(files) >= 5
    back = spark.read.parquet(f"{scratch}/hot")
    assert back.count() == n and back.where(F.col("region") == "HOT").count() == n // 3
