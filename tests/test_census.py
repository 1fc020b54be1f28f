"""Census version registry: role sizes per version, housing extension, schema check."""

import pytest

from regemb import census as C
from regemb.operators import clean
from regemb.plans.sort import sort_by_region

# (weights, meta, discrete, alloc, real, drops, renames, geo) per version
EXPECTED = {
    "2006-10": (81, 5, 78, 44, 18, 0, 0, "00"),
    "2007-11": (81, 5, 78, 44, 18, 0, 0, "00"),
    "2010-14_12-14": (81, 5, 101, 69, 19, 16, 15, "10"),
    "2011-15_12-15": (81, 5, 101, 74, 19, 16, 15, "10"),
    "2012-16": (81, 5, 102, 75, 19, 0, 80, "10"),
    "2013-17": (81, 5, 102, 76, 19, 2, 80, "10"),
    "2014-18": (81, 5, 102, 76, 19, 2, 80, "10"),
    "2015": (81, 5, 102, 76, 19, 2, 80, "10"),
    "housing_2014-18": (81, 4, 73, 57, 18, 2, 0, "10"),
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_role_sizes(name):
    s = C.VERSIONS[name]
    got = (len(s.weights), len(s.meta), len(s.discrete), len(s.alloc), len(s.real),
           len(s.drops), len(s.renames), s.geo_year)
    assert got == EXPECTED[name]


def test_person_plus_housing():
    s = C.version("2014-18", with_housing=True)
    assert len(s.weights) == 162
    assert set(s.adjust) == {"ADJINC", "ADJHSG"}
    assert len(s.adjust["ADJINC"]) == 12


def test_schema_check_on_a_version(spark):
    spec = C.V2012_16
    cols = sorted(spec.expected_columns() | {"ADJINC"})
    df = spark.createDataFrame([tuple("1" for _ in cols)], ", ".join(f"`{c}` string" for c in cols))
    clean.check_schema(df, spec)
    with pytest.raises(clean.SchemaError, match="WKHP"):
        clean.check_schema(df.drop("WKHP"), spec)


def _one_row(spark, spec, **values):
    cols = sorted(spec.expected_columns() | set(spec.adjust) | set(spec.drops))
    return spark.createDataFrame([tuple(values.get(c, "1") for c in cols)],
                                 ", ".join(f"`{c}` string" for c in cols))


def test_sort_job_adjusts_housing_amounts(spark):
    spec = C.version("2014-18", with_housing=True)
    persons = _one_row(spark, C.V2014_18, SERIALNO="h1", AGEP="30", WAGP="1000", ADJINC="1100000",
                       ST="06", PUMA="00100")
    housing = _one_row(spark, C.H2014_18, SERIALNO="h1", ELEP="100", FINCP="1000",
                       ADJINC="1100000", ADJHSG="1200000")
    lookup = spark.createDataFrame([("6", "100", "CA_1")], "ST string, PUMA string, region string")
    res = sort_by_region(persons, spec, lookup, ["ST", "PUMA"], housing=housing, sample_size=5)
    row = res.data.first()
    assert (row["region"], row["WAGP"], row["ELEP"], row["FINCP"]) == \
        ("CA_1", pytest.approx(1100), pytest.approx(120), pytest.approx(1100))
    assert res.stats.sample.count() == 1
    states = spark.createDataFrame([(6, "CA")], "state int, stab string")
    by = [sort_by_region(persons, spec, states, ["ST"], housing=housing, sample_size=0,
                         region_type=t).data.first()["region"] for t in ("state", "puma")]
    assert by == ["CA", "CA_00100"]
    with pytest.raises(ValueError):
        sort_by_region(persons, spec, states, ["ST"], housing=housing, region_type="county")
