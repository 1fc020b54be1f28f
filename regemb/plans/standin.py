"""Stand-in microdata built from the driver's TPC-H-like tables.

The census files are not available, so the test tables play their roles:

==================  ==========================================================
person rows         ``lineitem`` (one row per line)
household rows      ``orders`` joined to ``customer`` (key ``o_orderkey``)
weight              ``l_quantity``
reals               ``l_extendedprice``, ``nullif(l_discount, 0)``, ``l_tax``
discrete            ``nullif(l_returnflag, 'N')``, ``l_linestatus``,
                    ``l_linenumber`` (as text)
allocation flag     ``o_orderstatus``
place code          ``st`` = customer nation key
region lookup       ``nation``: nation key -> ``n_name``
super-region        ``region`` via ``n_regionkey`` -> ``r_name``
income factor       ``adjinc = 1000000 + 10000 * (2001 - year(o_orderdate))``
==================  ==========================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regemb.operators.clean import join_housing
from regemb.operators.regions import assign_region
from regemb.spec import MicrodataSpec

STANDIN = MicrodataSpec(
    name="tpch-standin",
    weight="l_quantity",
    real=("l_extendedprice", "l_discount", "l_tax"),
    discrete=("l_returnflag", "l_linestatus", "l_linenumber"),
    alloc=("o_orderstatus",),
    meta=("l_orderkey", "st"),
    key="l_orderkey",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def person_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person-level rows: pruned ``lineitem`` with injected nulls."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        "l_quantity",
        "l_extendedprice",
        F.expr("nullif(l_discount, 0.0)").alias("l_discount"),
        "l_tax",
        F.expr("nullif(l_returnflag, 'N')").alias("l_returnflag"),
        "l_linestatus",
        F.col("l_linenumber").cast("string").alias("l_linenumber"),
    )


def household_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Household-level rows: ``orders`` with the customer's nation as place."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (o.join(c, o.o_custkey == c.c_custkey, "inner")
             .select(F.col("o_orderkey").alias("l_orderkey"),
                     F.col("c_nationkey").alias("st"),
                     "o_orderstatus",
                     (F.lit(1000000) + F.lit(10000) * (F.lit(2001) - F.year("o_orderdate")))
                     .alias("adjinc"),
                     F.year("o_orderdate").alias("batch")))


def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place code -> region name (the ``puma_region`` role)."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("st"), F.col("n_name").alias("region"))


def superregion_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region -> super-region (the ``region_superregion`` role)."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("n_name").alias("region"), F.col("r_name").alias("merged_region")))


def person(spark: SparkSession, sf_dir: str, with_region: bool = True) -> DataFrame:
    """Persons joined to their household (J1), with a region."""
    df = join_housing(person_lines(spark, sf_dir), household_rows(spark, sf_dir),
                      key="l_orderkey")
    if with_region:
        df = assign_region(df, region_lookup(spark, sf_dir), on=["st"])
    return df


#: Stand-in census codes of an order: ``(o_orderkey * k + day of month) mod m``, plus ``low``.
CENSUS_CODES = {
    "LANP": (7, 1000, 0), "ANC1P": (11, 1000, 0), "ANC2P": (13, 1000, 0), "MIL": (3, 6, 0),
    "SCHL": (5, 25, 1), "SCHG": (17, 17, 0), "FER": (19, 9, 0), "HISP": (23, 24, 1),
    "RAC1P": (29, 9, 1), "RAC2P": (31, 69, 1), "FOD1P": (37, 25, 0), "OCCP": (41, 9921, 0),
    "occp10": (43, 9921, 0), "occp02": (47, 9921, 0),
}
#: Industry codes: a sector prefix picked the same way, null where every third order lacks it.
CENSUS_INDUSTRY = {"NAICSP": (53, 1), "naicsp07": (59, 3), "naicsp02": (61, 1)}
CENSUS_OTHER = 5


def census_rows(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """One stand-in person per order with every feature of a census file version."""
    from regemb import census
    from regemb.functions.recode import NAICS_SECTORS
    spec = census.version(version)
    key, day = F.col("o_orderkey"), F.dayofmonth("o_orderdate")
    prefixes = F.array(*[F.lit(p) for p in NAICS_SECTORS])

    def column(c: str, i: int) -> Column:
        if c in CENSUS_CODES:
            k, m, low = CENSUS_CODES[c]
            x = (F.pmod(key * k + day, F.lit(m)) + low).cast("string")
            # the newer of two occupation codes is missing now and then
            return F.when(key % 3 > 0, x) if c == "occp10" else x
        if c in CENSUS_INDUSTRY:
            k, every = CENSUS_INDUSTRY[c]
            at = F.pmod(key * k + day, F.lit(len(NAICS_SECTORS))).cast("int")
            x = F.concat(F.element_at(prefixes, at + 1), F.lit("1"))
            return F.when(key % 3 > 0, x) if every > 1 else x
        x = F.pmod(key * (i + 3) + day, F.lit(CENSUS_OTHER))
        return x.cast("double") if c in spec.real else x.cast("string")

    return table(spark, sf_dir, "orders").select(
        F.lit(1.0).alias(spec.weight), key.alias("SPORDER"),
        *[column(c, i).alias(c) for i, c in enumerate(spec.features)])


def census_rows_sql() -> str:
    """``census``: the same codes in SQL, all columns of :data:`CENSUS_CODES` at once."""
    from regemb.functions.recode import NAICS_SECTORS
    day, cols = "CAST(day(o_orderdate) AS BIGINT)", []
    for c, (k, m, low) in CENSUS_CODES.items():
        x = f"CAST((o_orderkey * {k} + {day}) % {m} + {low} AS VARCHAR)"
        cols.append(f"CASE WHEN o_orderkey % 3 > 0 THEN {x} END AS {c}" if c == "occp10"
                    else f"{x} AS {c}")
    listed = "[" + ", ".join(f"'{p}'" for p in NAICS_SECTORS) + "]"
    for c, (k, every) in CENSUS_INDUSTRY.items():
        x = f"{listed}[(o_orderkey * {k} + {day}) % {len(NAICS_SECTORS)} + 1] || '1'"
        cols.append(f"CASE WHEN o_orderkey % 3 > 0 THEN {x} END AS {c}" if every > 1
                    else f"{x} AS {c}")
    return "census AS (SELECT " + ", ".join(cols) + " FROM orders)"


def price_tax_features(Z, idx):
    """A stand-in user featurizer (X2) over encoded rows: standardised price,
    price x discount and tax squared.  It lives in the package so Python
    workers can import it."""
    import numpy as np
    return np.c_[Z[:, 0], Z[:, 0] * Z[:, 1], Z[:, 2] ** 2]


def person_sql(region_expr: str = "n.n_name") -> str:
    """DuckDB/ANSI text of the same view (a ``person`` CTE), for oracles."""
    return f"""
person AS (
  SELECT l.l_orderkey, l.l_quantity, l.l_extendedprice,
         nullif(l.l_discount, 0.0) AS l_discount, l.l_tax,
         nullif(l.l_returnflag, 'N') AS l_returnflag, l.l_linestatus,
         CAST(l.l_linenumber AS VARCHAR) AS l_linenumber,
         c.c_nationkey AS st, o.o_orderstatus,
         1000000 + 10000 * (2001 - year(o.o_orderdate)) AS adjinc,
         year(o.o_orderdate) AS batch,
         {region_expr} AS region
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


PERSON_SQL = person_sql()
