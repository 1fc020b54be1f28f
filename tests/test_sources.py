"""CSV-based sources (S1, S2, S11, S13, S14, S15) on small files."""

import os

import pytest
from pyspark.sql import functions as F

from regemb.operators import votes as V
from regemb.operators.clean import SchemaError
from regemb.sources import lookups, microdata
from regemb.spec import MicrodataSpec

SPEC = MicrodataSpec(name="t", weight="PWGTP", real=("AGEP",), discrete=("SEX",),
                     meta=("SERIALNO",), adjust={"ADJINC": ("AGEP",)})


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_csv_typed_by_name_with_na_tokens(spark, scratch):
    _write(f"{scratch}/a.csv", "SERIALNO,PWGTP,AGEP,SEX,ADJINC\nN.A.,3, 40,1,1000000\n7,2,,2,1000000\n")
    _write(f"{scratch}/b.csv", "SERIALNO,PWGTP,AGEP,SEX,ADJINC\n9,1,30,1,1000000\n")
    df = microdata.read_csv(spark, [f"{scratch}/a.csv", f"{scratch}/b.csv"], SPEC)
    rows = sorted(df.collect(), key=lambda r: (r["SERIALNO"] or ""))
    assert rows[0]["SERIALNO"] is None and rows[0]["AGEP"] == 40.0
    assert dict(df.dtypes)["PWGTP"] == "double" and dict(df.dtypes)["ADJINC"] == "bigint"
    assert any(r["AGEP"] is None for r in rows)


def test_csv_files_must_share_columns(spark, scratch):
    _write(f"{scratch}/a.csv", "SERIALNO,PWGTP,AGEP,SEX\n1,3,40,1\n")
    _write(f"{scratch}/b.csv", "SERIALNO,PWGTP,AGEP,RACE\n1,3,40,1\n")
    with pytest.raises(SchemaError, match="RACE"):
        microdata.read_csv(spark, [f"{scratch}/a.csv", f"{scratch}/b.csv"], SPEC)


@pytest.mark.parametrize("how", ["list", "glob", "folder"])
def test_shuffled_headers_bind_by_name(spark, scratch, how):
    _write(f"{scratch}/in/a.csv", "SERIALNO,PWGTP,AGEP,SEX\n1,3,40,1\n")
    _write(f"{scratch}/in/b.csv", "SEX,AGEP,SERIALNO,PWGTP\n2,50,2,4\n")
    _write(f"{scratch}/in/c.csv", "SERIALNO,PWGTP,AGEP,SEX\n3,5,60,1\n")
    paths = {"list": [f"{scratch}/in/{x}.csv" for x in "abc"], "glob": f"{scratch}/in/*.csv",
             "folder": f"{scratch}/in"}[how]
    got = {(r["SERIALNO"], r["PWGTP"], r["AGEP"], r["SEX"])
           for r in microdata.read_csv(spark, paths, SPEC).collect()}
    assert got == {("1", 3.0, 40.0, "1"), ("2", 4.0, 50.0, "2"), ("3", 5.0, 60.0, "1")}


def test_bad_weight_raises_or_is_listed(spark, scratch):
    _write(f"{scratch}/a.csv", "SERIALNO,PWGTP,AGEP,SEX,ADJINC\n1,3x,40,1,5\n2,,41,1,5\n3,3x,4,1,\n")
    with pytest.raises(Exception, match="PWGTP is not a number: 3x"):
        microdata.read_csv(spark, f"{scratch}/a.csv", SPEC).collect()
    kept = microdata.read_csv(spark, f"{scratch}/a.csv", SPEC, on_bad="null").collect()
    assert [r["PWGTP"] for r in kept] == [None, None, None]
    bad = microdata.bad_values(microdata.read_text(spark, f"{scratch}/a.csv"), SPEC).collect()
    assert [tuple(r) for r in bad] == [("PWGTP", "3x", 2)]


def test_no_file_is_an_error(spark, scratch):
    with pytest.raises(Exception):
        microdata.read_csv(spark, f"{scratch}/none", SPEC)


def test_partitions_must_share_columns(spark, scratch):
    a = spark.createDataFrame([("1", 2.0)], "SERIALNO string, PWGTP double")
    a.write.parquet(f"{scratch}/a")
    a.select("PWGTP", "SERIALNO").write.parquet(f"{scratch}/b")
    assert microdata.read_partitions(spark, [f"{scratch}/a", f"{scratch}/b"], SPEC).count() == 2
    a.withColumn("X", F.lit(1)).write.parquet(f"{scratch}/c")
    with pytest.raises(SchemaError, match="X"):
        microdata.read_partitions(spark, [f"{scratch}/a", f"{scratch}/c"], SPEC)


def test_code_table_with_quoted_commas(spark, scratch):
    _write(f"{scratch}/codes.csv",
           'code,name,subcat,cat,cat_code\n1100,"Agriculture, General",x,Ag,1\n2100,Computing,y,CS,2\n')
    t = lookups.read_codes(spark, f"{scratch}/codes.csv").collect()
    assert [(r["code"], r["name"], r["cat_code"]) for r in t] == [
        (1100, "Agriculture, General", "1"), (2100, "Computing", "2")]


def test_crosswalk_label_row_dropped(spark, scratch):
    _write(f"{scratch}/xw.csv", "county,state,puma12\nCounty code,State code,PUMA\n01001,1,2100\n")
    t = lookups.read_crosswalk(spark, f"{scratch}/xw.csv", "puma12").collect()
    assert [(r["county"], r["puma12"]) for r in t] == [("01001", "2100")]


def test_election_and_state_files(spark, scratch):
    _write(f"{scratch}/el.csv", "region,votes_D,votes_R\nAL_00_01,10,20\n")
    el = lookups.read_election(spark, f"{scratch}/el.csv")
    assert dict(el.dtypes)["votes_D"] == "bigint"
    _write(f"{scratch}/st/ak.csv", "fips,county,candidate,votes\n02013,A,Obama,5\n")
    _write(f"{scratch}/st/wy.csv", "fips,county,candidate,votes\n56001,B,Mitt Romney,7\n")
    r = V.read_state_files(spark, f"{scratch}/st/??.csv")
    got = sorted((x["state"], x["fips"], x["votes"]) for x in r.collect())
    assert got == [("ak", "02013", 5), ("wy", "56001", 7)]
    norm = r.select(V.normalize_candidate("candidate").alias("c")).collect()
    assert sorted(x["c"] for x in norm) == ["barack obama", "mitt romney"]


def test_preprocessor_hook_recomputes_stats(spark):
    from regemb.plans.featurize import featurize
    df = spark.createDataFrame([("a", 1.0, 20.0, "1"), ("a", 1.0, 40.0, "2")],
                               "region string, PWGTP double, AGEP double, SEX string")
    spec = MicrodataSpec(name="t", weight="PWGTP", real=("AGEP",), discrete=("SEX", "OLD"))
    out = featurize(df, spec=spec,
                    preprocessor=lambda d: d.withColumn("OLD", (F.col("AGEP") > 30).cast("string")))
    names = {r["feature_name"] for r in out["lin"].values.collect()}
    assert {"OLD_true", "OLD_false", "SEX_1", "SEX_2", "AGEP"} <= names
