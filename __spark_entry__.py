"""

Every query reads the driver's test tables (the stand-in microdata of
``regemb.plans.standin``) through the library's operators; every oracle is
the same computation restated in SQL over the raw tables.  Doubles are
rounded to 6 places on both sides because summation order differs.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import numpy as np

from regemb.operators import clean, distances, embed, encode, graph, regions, rff, rollup, setops
from regemb.operators import stats as st
from regemb.functions import census_profile as CP
from regemb.functions import geo as G
from regemb.functions import recode as R
from regemb.operators import geo as GO
from regemb.operators import gram as GR
from regemb.operators import regress as M
from regemb.operators import votes as V
from regemb.plans import featurize as FZ
from regemb.plans import sqltext as S
from regemb.plans.sort import sort_by_region
from regemb.session import scratch_path
from regemb.sources import lookups, microdata, sinks
from regemb.spec import skip_features
from regemb.plans.standin import (STANDIN, census_rows, census_rows_sql, household_rows, person,
                                  person_lines, region_lookup, superregion_lookup, table)

try:  # the training-data operators are an optional part
    import corpus_pipeline as _pipeline
    from regemb.llm import queries as _llm
except ModuleNotFoundError as e:
    if e.name not in ("corpus_pipeline", "regemb.llm", "regemb.llm.queries"):
        raise
    _llm = _pipeline = None

SF_SMOKE = "/root/testdata/sf0.001"


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def _stats(spark, sf_dir, sample=0):
    p = person(spark, sf_dir)
    return p, st.compute_stats(p, STANDIN, sample_size=sample)


# --- queries ---------------------------------------------------------------


def q_linear_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + F2 + A6: linear embedding of every nation (flagship)."""
    p, s = _stats(spark, sf_dir)
    return _r(embed.linear_embedding(p, s).values, "value")


def q_region_weights(spark, sf_dir):
    p, s = _stats(spark, sf_dir)
    return _r(embed.linear_embedding(p, s).weights, "weight")


SUBSETS = ["l_extendedprice > 50000 AND l_returnflag = 'R'",
           "NOT (l_returnflag <=> 'A')"]
SUBSETS_SQL = ["l_extendedprice > 50000 AND l_returnflag = 'R'",
               "l_returnflag IS DISTINCT FROM 'A'"]


def q_subset_weights(spark, sf_dir):
    """P10 + A7 + A9: region weight per subset."""
    p = person(spark, sf_dir)
    return _r(embed.region_weights(p, STANDIN.weight, subsets=SUBSETS), "weight")


def q_subset_embedding(spark, sf_dir):
    """P10 + A7: linear embedding for two subsets in one pass."""
    p, s = _stats(spark, sf_dir)
    return _r(embed.linear_embedding(p, s, subsets=SUBSETS).values, "value")


def q_real_stats(spark, sf_dir):
    """A2: count, mean, population std of each real."""
    p, s = _stats(spark, sf_dir)
    return _r(s.reals, "mean", "std")


def q_value_counts(spark, sf_dir):
    """A4: value counts of discrete features and allocation flags."""
    p, s = _stats(spark, sf_dir)
    return s.value_counts


def q_totals(spark, sf_dir):
    """A1: row and weight totals."""
    p, s = _stats(spark, sf_dir)
    return _r(s.totals, "wt_total")


def q_needs_nan(spark, sf_dir):
    """A5: which discrete features need a nan level."""
    p, s = _stats(spark, sf_dir)
    return s.needs_nan_df()


def q_catalogue(spark, sf_dir):
    """Feature positions, names, ids and keep flags."""
    p, s = _stats(spark, sf_dir)
    return encode.catalogue(s, set(STANDIN.alloc))


THERMO = {"l_returnflag": ["A", "R"], "l_linenumber": [str(i) for i in range(1, 8)]}


def q_thermometer(spark, sf_dir):
    """Thermometer (ordered) coding means."""
    p, s = _stats(spark, sf_dir)
    e = embed.linear_embedding(p, s, ordered=THERMO)
    return _r(e.values.where(F.col("feature_id").isin(list(THERMO))), "value")


PAIRS = [("l_returnflag", "l_linestatus"), ("l_returnflag", "o_orderstatus"),
         ("l_linestatus", "o_orderstatus")]


def q_interactions(spark, sf_dir):
    """Discrete x discrete level-pair shares."""
    p, s = _stats(spark, sf_dir)
    return _r(embed.interaction_embedding(p, s, PAIRS, subsets=SUBSETS).values.drop("pos"),
              "value")


def q_shared_pass(spark, sf_dir):
    """Linear embedding and interactions from one shared scan."""
    p, s = _stats(spark, sf_dir)
    lin, inter = embed.linear_with_interactions(p, s, PAIRS, subsets=SUBSETS)
    return _r(lin.values.select("region", "subset", "feature_name", "feature_id", "value")
              .unionByName(inter.values.drop("pos")), "value")


def q_custom_featurizer(spark, sf_dir):
    """A user featurizer (numpy over encoded rows) averaged per region."""
    from regemb.plans.standin import price_tax_features
    p, s = _stats(spark, sf_dir)
    return _r(rff.custom_embedding(p, s, price_tax_features, 3, "custom").values, "value")


def q_weighted_sample(spark, sf_dir):
    """K1: 500 orders drawn with probability ~ floor(price/1000)+1."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn(
        "w", F.floor(F.col("o_totalprice") / 1000) + 1)
    return st.weighted_sample(o, "w", 500, key="o_orderkey").select("o_orderkey", "w")


# fixed test frequencies: 64 rows (positions) x 4 frequencies, bandwidth 2
FREQS = rff.gaussian_freqs(64, 4, bandwidth=2.0, seed=7)


def _freqs(s: st.Stats) -> np.ndarray:
    """The rows of ``FREQS`` for the encoded columns of these stats."""
    return FREQS[:encode.feature_count(s, skip_features(s.spec))]

ONE = rff.gaussian_freqs(1, 4, bandwidth=1.0, seed=11)
PAIR = rff.orthogonal_freqs(2, 4, bandwidth=1.5, seed=13)


def q_rff_embedding(spark, sf_dir):
    """A10 (+M4 given frequencies): RFF mean embedding over all features."""
    p, s = _stats(spark, sf_dir)
    return _r(rff.rff_embedding(p, s, freqs=_freqs(s)).values, "value")


def q_rff_thermometer(spark, sf_dir):
    """A10 + F3: RFF with thermometer-coded ordered features."""
    p, s = _stats(spark, sf_dir)
    return _r(rff.rff_embedding(p, s, freqs=_freqs(s), ordered=THERMO).values, "value")


def q_rff_one_real(spark, sf_dir):
    """RFF of one standardised real."""
    p, s = _stats(spark, sf_dir)
    return _r(rff.real_rff_embedding(p, s, ["l_extendedprice"], ONE).values, "value")


def q_rff_real_pair(spark, sf_dir):
    """RFF of a pair of reals (orthogonal frequencies, M2)."""
    p, s = _stats(spark, sf_dir)
    return _r(rff.real_rff_embedding(p, s, ["l_extendedprice", "l_tax"], PAIR).values, "value")


def q_rff_conditional(spark, sf_dir):
    """RFF of a real conditional on each level of a discrete feature."""
    p, s = _stats(spark, sf_dir)
    e = rff.real_rff_embedding(p, s, ["l_extendedprice"], ONE, condition="l_returnflag")
    return _r(e.values, "value")


def q_extras_one_pass(spark, sf_dir):
    """X3 for A11-A13: one real, a real pair and a conditional block from one scan."""
    p, s = _stats(spark, sf_dir)
    embs = rff.multi_real_rff(p, s, [(["l_extendedprice"], ONE, None),
                                     (["l_extendedprice", "l_tax"], PAIR, None),
                                     (["l_extendedprice"], ONE, "l_returnflag")])
    parts = [e.values if "level" in e.values.columns
             else e.values.withColumn("level", F.lit(None).cast("string")) for e in embs]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _r(out, "value")


def q_median_heuristic(spark, sf_dir):
    """K1 + J11 + A19: exact median pairwise distance of a 5,000-row sample."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("w", F.lit(1.0))
    samp = st.weighted_sample(e, "w", 5000, key="vec_id")
    return _r(distances.median_sq_distance_df(spark, samp, "embedding"),
              "median_sq_dist", "bandwidth")


def q_median_ties(spark, sf_dir):
    """A19 where most distances tie: one integer real of a 5,000-row sample."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit(1.0).alias("w"),
        F.array(F.substring("o_orderpriority", 1, 1).cast("double")).alias("v"))
    samp = st.weighted_sample(o, "w", 5000, key="o_orderkey")
    return _r(distances.median_sq_distance_df(spark, samp, "v"), "median_sq_dist", "bandwidth")


# whole-row key of a person, in whole cents so that every engine writes the same text
PERSON_KEY = ["l_orderkey", "l_linenumber", "cents", "qty", "disc", "tax", "l_returnflag",
              "l_linestatus"]


def _keyed_person(spark, sf_dir):
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return person(spark, sf_dir).withColumns({
        "cents": cents("l_extendedprice"), "qty": F.col("l_quantity").cast("long"),
        "disc": cents("l_discount"), "tax": cents("l_tax")})


KEYED_PERSON_SQL = """
kp AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
              CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_discount * 100) AS BIGINT) AS disc,
              CAST(round(l_tax * 100) AS BIGINT) AS tax FROM person),
ku AS (SELECT *, concat_ws(chr(31), """ + ", ".join(
    f"coalesce(CAST({k} AS VARCHAR), '')" for k in PERSON_KEY) + """) AS k FROM kp),
samp AS (SELECT * FROM ku
         ORDER BY CASE WHEN l_quantity > 0 THEN -ln(""" + S.hash_uniform_sql("k") + """) / l_quantity
                       ELSE 'inf'::DOUBLE END, """ + ", ".join(PERSON_KEY) + """
         LIMIT {n})"""


def q_person_sample(spark, sf_dir):
    """K1 over persons, several to a household, each drawn by itself."""
    s = st.weighted_sample(_keyed_person(spark, sf_dir), STANDIN.weight, 500, key=PERSON_KEY)
    return s.select(*PERSON_KEY)


def q_batch_merge_embedding(spark, sf_dir):
    """Embeddings of yearly batches recombined by weight share."""
    p, s = _stats(spark, sf_dir)
    pb = p.withColumn("_rb", F.concat_ws("\x1f", "region", F.col("batch").cast("string")))
    e = embed.linear_embedding(pb, s, region_col="_rb")
    split = lambda d: (d.withColumn("batch", F.split_part(F.col("region"), F.lit("\x1f"), F.lit(2)))
                        .withColumn("region", F.split_part(F.col("region"), F.lit("\x1f"), F.lit(1))))
    m = embed.merge_batches(split(e.values), split(e.weights))
    return _r(m.values, "value")


def q_batch_merge_moments(spark, sf_dir):
    """A3: real moments of yearly batches recombined."""
    p = person(spark, sf_dir)
    b = st.real_moments(p, list(STANDIN.real), by=["batch"])
    return _r(st.merge_moments(b), "mean", "std")


def _lin(spark, sf_dir):
    p, s = _stats(spark, sf_dir)
    return p, s, embed.linear_embedding(p, s)


def q_superregion_rollup(spark, sf_dir):
    """A15 + A17 + J7: nation embeddings rolled up to world regions."""
    _, _, e = _lin(spark, sf_dir)
    return _r(rollup.superregion_rollup(e, superregion_lookup(spark, sf_dir)).values, "value")


def q_superregion_weights(spark, sf_dir):
    """A15 + A9: rolled-up target weights."""
    _, _, e = _lin(spark, sf_dir)
    return _r(rollup.superregion_rollup(e, superregion_lookup(spark, sf_dir)).weights, "weight")


def q_state_rollup(spark, sf_dir):
    """Roll-up to the first two characters of the region name."""
    _, _, e = _lin(spark, sf_dir)
    return _r(rollup.state_rollup(e).values, "value")


def q_rollup_all(spark, sf_dir):
    """Linear and RFF embeddings rolled up together."""
    p, s, e = _lin(spark, sf_dir)
    r = rff.rff_embedding(p, s, freqs=_freqs(s))
    out = rollup.rollup_all([e, r], mapping=superregion_lookup(spark, sf_dir))
    return _r(out[0].values.withColumn("kind", F.lit("lin")).unionByName(
        out[1].values.withColumn("kind", F.lit("rff"))), "value")


def q_rollup_conditional(spark, sf_dir):
    """A15 on A13: conditional RFF rolled up by each level's own weight."""
    p, s = _stats(spark, sf_dir)
    e = rff.real_rff_embedding(p, s, ["l_extendedprice"], ONE, condition="l_returnflag")
    return _r(rollup.superregion_rollup(e, superregion_lookup(spark, sf_dir)).values, "value")


CLEAN_SPEC = STANDIN.__class__(
    name="tpch-standin-raw", weight="l_quantity", real=STANDIN.real,
    discrete=STANDIN.discrete, alloc=STANDIN.alloc, meta=("l_orderkey", "st", "PUMA"),
    adjust={"adjinc": ("l_extendedprice", "l_tax")}, drops=("l_linestatus",),
    renames={"l_returnflag": "RFLAG"}, geo_year="10", era_subset=True)


def q_clean_chain(spark, sf_dir):
    """P2 + P3 + P4 + P5 + P6: era filter, voter filter, drop, rename, adjust."""
    raw = (person(spark, sf_dir, with_region=False)
           .withColumn("PUMA10", F.when(F.col("l_linenumber") == "7", F.lit(-9))
                       .otherwise(F.col("st")))
           .withColumn("PUMA00", F.when(F.col("l_linenumber") == "7", F.col("st"))
                       .otherwise(F.lit(-9)))
           .withColumn("AGEP", F.col("l_linenumber").cast("int") * 6)
           .withColumn("CIT", F.when(F.col("o_orderstatus") == "F", F.lit("5"))
                       .when(F.col("o_orderstatus") == "P", F.lit("b"))))
    c = clean.clean(raw, CLEAN_SPEC, voters=True)
    return _r(c.groupBy("PUMA", "RFLAG").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("wt"),
        F.sum("l_extendedprice").alias("price_adj"), F.sum("l_tax").alias("tax_adj"),
        F.max("adjinc_orig").alias("max_factor")), "wt", "price_adj", "tax_adj")


def q_household_join(spark, sf_dir):
    """Persons joined to households; unmatched persons vanish."""
    j = clean.join_housing(person_lines(spark, sf_dir), household_rows(spark, sf_dir),
                           key="l_orderkey")
    return _r(j.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                             F.sum("l_quantity").alias("wt")), "wt")


def _partial_lookup(spark, sf_dir):
    # nation 0 left out of the lookup so some places stay unmapped
    return region_lookup(spark, sf_dir).where(F.col("st") != 0)


def q_unmapped_report(spark, sf_dir):
    """J3 + J6 + K2: places with no region, most common first."""
    p = person(spark, sf_dir, with_region=False)
    a = regions.assign_region(p, _partial_lookup(spark, sf_dir), on=["st"])
    return regions.unmapped_report(a, ["st", "l_linenumber"])


def q_mapped_weights(spark, sf_dir):
    """J3 + J6: unmapped rows leave the region partitions (but not the stats)."""
    p = person(spark, sf_dir, with_region=False)
    a = regions.mapped_only(regions.assign_region(p, _partial_lookup(spark, sf_dir), on=["st"]))
    return _r(embed.region_weights(a, STANDIN.weight), "weight")


def _stab(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("state"),
                    F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
                    .alias("stab"))


def q_state_regions(spark, sf_dir):
    """State code -> postal-code region."""
    p = person(spark, sf_dir, with_region=False).withColumn(
        "ST", F.lpad(F.col("st").cast("string"), 2, "0"))
    a = regions.assign_state(p, _stab(spark, sf_dir), st="ST")
    return _r(embed.region_weights(a, STANDIN.weight), "weight")


def q_puma_regions(spark, sf_dir):
    """``<stab>_<puma>`` regions."""
    p = person(spark, sf_dir, with_region=False).withColumnRenamed("st", "ST") \
        .withColumn("PUMA", F.col("l_linenumber").cast("int"))
    a = regions.assign_puma_region(p, _stab(spark, sf_dir))
    return _r(embed.region_weights(a, STANDIN.weight), "weight")


def q_coverage(spark, sf_dir):
    """J10 + U5: days with sales only / with returns only, and rows whose day is missing."""
    li = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    sold = li.where("l_returnflag = 'N'").select(
        F.when(F.col("l_linenumber") != 7, day).alias("k"))
    back = li.where("l_returnflag <> 'N'").select(day.alias("k"))
    cov = regions.coverage(sold, back, "k")
    sides = [cov[c].groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(c))
             for c in ("left_only", "right_only", "left_null")]
    return setops.union_all(sides)


def q_set_ops(spark, sf_dir):
    """U1 + U3 + U4 + U7: union, alias-row augmentation, distinct pairs."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"),
                                                F.lit("c").alias("src"))
    s_ = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    u = setops.union_all([c, s_])
    u = setops.augment_alias_rows(u, F.col("k").isin(1, 2), "k", 77777)
    pairs = setops.distinct_pairs(
        u.join(n, u.k == n.n_nationkey, "left").withColumn("src", F.coalesce("src", F.lit("s"))),
        "k", "src")
    return pairs


def q_set_equal(spark, sf_dir):
    """Do customers and suppliers cover the same nations?"""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s_ = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    eq = setops.same_sets(c, s_)
    return (c.distinct().agg(F.count(F.lit(1)).alias("n_customer_nations"))
            .withColumn("same", F.lit(eq)))


def _place_pairs(spark, sf_dir):
    """County-PUMA stand-in: customer <-> (nation, month, priority) cells."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    nat = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .select(F.concat(nat, F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
                     .alias("county"),
                     F.concat(nat, F.lit("_"), F.date_format("o_orderdate", "yyyyMM"),
                              F.substring("o_orderpriority", 1, 1)).alias("puma"))
             .distinct())


PAIRS_SQL = """
pairs AS (SELECT DISTINCT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-'
                 || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS county,
                 lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '_' || strftime(o_orderdate, '%Y%m')
                 || substr(o_orderpriority, 1, 1) AS puma
          FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT 'L:' || county AS a, 'R:' || puma AS b FROM pairs),
und AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk(node, root) AS (SELECT a, a FROM und
                     UNION SELECT und.b, walk.root FROM walk JOIN und ON walk.node = und.a),
comp AS (SELECT CASE WHEN node LIKE 'L:%' THEN 'left' ELSE 'right' END AS side,
                substr(node, 3) AS key, min(root) AS component FROM walk GROUP BY node)"""


def _members(spark, sf_dir):
    m = graph.bipartite_components(_place_pairs(spark, sf_dir), "county", "puma")
    return m.withColumn("st", F.substring("key", 1, 2))


def q_components(spark, sf_dir):
    """G1: connected components of the bipartite place graph."""
    return graph.bipartite_components(_place_pairs(spark, sf_dir), "county", "puma")


def q_region_names(spark, sf_dir):
    """G3 + W1 + O19: county -> region named ``<stab>_00_<nn>`` per state."""
    m = _members(spark, sf_dir)
    stab = table(spark, sf_dir, "nation").select(
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("st"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("stab"))
    names = graph.name_regions(m, "st", "00", stab)
    return graph.membership(m, names)["left"]


def q_forced_merge(spark, sf_dir):
    """Every component touching state 02 forced into one."""
    pairs = _place_pairs(spark, sf_dir)
    forced = {"02": pairs.where(F.col("county").startswith("02-")).select("county")}
    m = graph.bipartite_components(pairs, "county", "puma", forced=forced)
    return m.groupBy(F.substring("key", 1, 2).alias("st")).agg(
        F.count_distinct("component").alias("n_components"))


def _codes(spark, sf_dir):
    """Census-like text codes derived from every order."""
    o = table(spark, sf_dir, "orders")
    day = F.dayofmonth("o_orderdate")
    return o.select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).alias("HISP"),
        F.month("o_orderdate").cast("string").alias("RAC1P"),
        day.cast("string").alias("SCHL"),
        (F.month("o_orderdate") + day).cast("string").alias("RAC2P"),
        F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "2")
         .otherwise("8").alias("FER"),
        (day * 7).cast("string").alias("ANC1P"),
        (day * 7 + 560).cast("string").alias("LANP"),
        F.lpad((day * 3).cast("string"), 2, "0").alias("NAICSP"),
        F.when(F.col("o_orderstatus") != "P", F.lpad((day * 3).cast("string"), 2, "0"))
         .alias("naicsp07"),
        F.lpad((F.month("o_orderdate") * 4).cast("string"), 2, "0").alias("naicsp02"),
        (F.col("o_totalprice") / 50).cast("int").cast("string").alias("OCCP"))


def q_recodes(spark, sf_dir):
    """Every recode applied to census-like codes."""
    c = _codes(spark, sf_dir)
    return c.select(
        "o_orderkey",
        R.industry_sector("NAICSP", on_unknown="null").alias("sector"),
        R.industry_sector(R.first_present("naicsp07", "naicsp02"), "null").alias("sector_old"),
        R.ethnicity("HISP", "RAC1P").alias("ethnicity"),
        R.any_hispanic("HISP").alias("anyhisp"),
        R.occupation_group("OCCP").alias("occ"),
        R.has_degree("SCHL").alias("hasdegree"),
        R.has_degree(R.remap("SCHL", R.SCHL_NEW_TO_OLD), R.DEGREE_CUTOFF_COMMON)
         .alias("hasdegree_common"),
        R.remap("SCHL", R.SCHG_NEW_TO_OLD).alias("schg"),
        R.remap("SCHL", R.SCHL_NEW_TO_OLD).alias("schl"),
        R.remap("HISP", R.MIL_OLD_TO_NEW).alias("mil"),
        R.remap("FER", R.FER_NEW_TO_OLD).alias("fer"),
        R.remap("LANP", R.LANP_NEW_TO_OLD, identity_default=True).alias("lanp"),
        R.remap("ANC1P", R.ANCP_NEW_TO_OLD, identity_default=True).alias("anc1p"),
        R.remap("RAC2P", R.RAC2P_NEW).alias("rac2p_new"),
        R.remap("RAC2P", R.RAC2P_OLD).alias("rac2p_old"))


def q_recode_profile(spark, sf_dir):
    """A recode profile over the code table, then counts of derived features."""
    c = _codes(spark, sf_dir)
    prof = R.RecodeProfile(
        derive={"ETHNICITY": R.ethnicity("HISP", "RAC1P"), "ANYHISP": R.any_hispanic("HISP"),
                "HASDEGREE": R.has_degree("SCHL"),
                "NAICSP": R.industry_sector("NAICSP", on_unknown="null")},
        keep={"SCHL", "RAC2P"}, skip={"FER", "ANC1P", "LANP", "naicsp07", "naicsp02",
                                      "OCCP", "HISP", "RAC1P"},
        meta={"o_orderkey"}, absent={"FOD1P"})
    r = R.apply_profile(c, prof)
    return r.groupBy("ETHNICITY", "ANYHISP", "HASDEGREE", "NAICSP").agg(
        F.count(F.lit(1)).alias("n"))


def q_regroup_counts(spark, sf_dir):
    """Value counts of SCHL regrouped to the old attainment codes."""
    c = _codes(spark, sf_dir)
    vc = st.value_counts(c, ["SCHL"])
    return R.regroup_counts(vc, "SCHL", R.remap(F.col("level"), R.SCHL_NEW_TO_OLD))


# stand-in aliases: four part names play the four main candidates
VOTE_ALIASES = {"red plate jr": "barack obama", "small widget jr": "mitt romney",
                "hot plate jr": "gary johnson", "hot ring jr": "jill stein"}


def _county_results(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    raw = F.concat(F.upper("p_name"), F.lit("  Jr, "), F.col("p_type"), F.lit(" (write-in)"))
    cand = V.normalize_candidate(raw, {**V.NAME_ALIASES, **VOTE_ALIASES})
    return j.select(F.lpad(F.col("l_suppkey").cast("string"), 5, "0").alias("fips"),
                    cand.alias("cand"), F.col("l_quantity").cast("long").alias("votes")) \
            .withColumn("party", V.party("cand"))


def q_top_candidates(spark, sf_dir):
    """O16 + A21 + K3: normalised names, votes summed, top 50."""
    return V.top_candidates(_county_results(spark, sf_dir), 50)


def q_votes_by_party(spark, sf_dir):
    """O17 + A22: votes by party."""
    return V.votes_by(_county_results(spark, sf_dir), "party")


def q_votes_by_region(spark, sf_dir):
    """J8 + A23: region x party pivot with integer totals."""
    s_ = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    cr = s_.join(n, s_.s_nationkey == n.n_nationkey).select(
        F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("fips"),
        F.col("n_name").alias("region"))
    return V.region_party_table(_county_results(spark, sf_dir), cr)


def q_precinct_rollup(spark, sf_dir):
    """A24 + U1: precinct rows (events) rolled into one county and appended."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("candidate"), F.round("value").cast("long").alias("votes"))
    roll = V.precinct_rollup(ev, "ev", "99999", "All events")
    other = _county_results(spark, sf_dir).groupBy("fips").agg(
        F.sum("votes").alias("votes")).withColumn("state", F.lit("li"))
    return setops.union_all([roll, other])


def q_cartesian(spark, sf_dir):
    """Centroid degrees -> Cartesian km (published convention)."""
    sup = table(spark, sf_dir, "supplier")
    x, y, z = G.to_cartesian(F.col("s_acctbal") / 200, F.col("s_acctbal") / 100)
    return _r(sup.select("s_suppkey", x.alias("x"), y.alias("y"), z.alias("z")), "x", "y", "z")


def _county_polygons(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    x0 = F.col("c_acctbal") / 1000
    y0 = F.col("c_nationkey").cast("double")
    w = F.abs(F.col("c_acctbal")) / 5000 + 0.1
    h = F.lit(0.5)
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(pt(x0, y0), pt(x0 + w, y0), pt(x0 + w, y0 + h), pt(x0, y0 + h))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("region"), ring.alias("polygon"))


def q_centroids(spark, sf_dir):
    """Area-weighted region centroids from county polygons."""
    return _r(GO.region_centroids(_county_polygons(spark, sf_dir)), "lon", "lat", "area")


SPATIAL_D = 8


def q_spatial_features(spark, sf_dir):
    """M9 + O18 + A25: Matern-3/2 random features of region centroids."""
    cen = GO.region_centroids(_county_polygons(spark, sf_dir))
    x, y, z = G.to_cartesian("lat", "lon")
    xyz = cen.select("region", x.alias("x"), y.alias("y"), z.alias("z"))
    f = M.matern32_features(xyz, n_freqs=SPATIAL_D, seed=5)
    return _r(f, *[f"m{j}" for j in range(2 * SPATIAL_D)])


def _regression_frame(spark, sf_dir):
    p, s = _stats(spark, sf_dir)
    skip = set(STANDIN.alloc) | {"l_returnflag"}
    e = embed.linear_embedding(p, s, skip=skip)
    positions = [r[0] for r in encode.catalogue_rows(s, skip)]
    names = [r[1] for r in encode.catalogue_rows(s, skip)]
    X = M.design_matrix(M.wide(e.values, positions))
    tgt = (p.groupBy("region").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("y"),
        F.sum(F.when(F.col("l_returnflag").isin("A", "R"), 1).otherwise(0)).alias("n"))
        .withColumn("share", F.col("y") / F.col("n")))
    # one row per region: cut the lineage before the iterative fits
    from regemb.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return M.align(X, tgt).checkpoint(), names


def q_regression(spark, sf_dir):
    """M6 + M7 + M8 + K5 + A26: ridge (CV penalty) and probit GLM on embeddings.

    Both are fitted on the training regions; each part is scored by itself.
    """
    df, _ = _regression_frame(spark, sf_dir)
    train, test = M.split(df, test_fraction=0.2, seed=1)
    out = []
    for name, model in (("ridge", M.ridge_cv(train, folds=3)),
                        ("probit", M.probit_binomial(train))):
        for part, rows in (("train", train), ("test", test)):
            scored = model.transform(rows)
            out.append(M.explained_variance(scored).withColumn("model", F.lit(name))
                       .withColumn("part", F.lit(part)))
    return setops.union_all(out)


RIDGE_PENALTY = 0.5


def _centroid_design(spark, sf_dir):
    """M6: mean tax of a nation and its centroid's latitude, with the share as label."""
    p, s = _stats(spark, sf_dir)
    e = embed.linear_embedding(p, s)
    wide = M.wide(e.values.where(F.col("feature_name") == "l_tax"), [2])
    cen = GO.region_centroids(_county_polygons(spark, sf_dir)).select("region", "lat")
    tgt = p.groupBy("region").agg(
        F.avg(F.when(F.col("l_returnflag") == "R", 1.0)
              .when(F.col("l_returnflag") == "A", 0.0)).alias("share"))
    return M.align(M.design_matrix(wide, cen), tgt).checkpoint()


def q_ridge_fixed(spark, sf_dir):
    """M6 + M7 + J9: ridge with a given penalty on embedding and centroid, in closed form."""
    df = _centroid_design(spark, sf_dir)
    fit = GR.ridge(GR.product_sums(df), RIDGE_PENALTY)
    return _r(GR.coefficients(fit, ["l_tax", "lat"], df), "coef")


def q_ridge_scores(spark, sf_dir):
    """M7 + A26 + K5: the fit on the training nations, scored on every part."""
    df = GR.split(_centroid_design(spark, sf_dir), test_fraction=0.3, seed=4)
    fit = GR.ridge(GR.product_sums(df.where("part = 'train'")), RIDGE_PENALTY)
    scored = fit.transform(df)
    return _r(scored.select("region", "part", "share", "prediction"), "share", "prediction")


def q_ridge_top(spark, sf_dir):
    """P12 + K4: the largest coefficient once a prefix is left out."""
    df = _centroid_design(spark, sf_dir)
    fit = GR.ridge(GR.product_sums(df), RIDGE_PENALTY)
    kept = M.prefix_filter(GR.coefficients(fit, ["l_tax", "lat"], df), ["("])
    return _r(M.top_coefficients(kept, 1), "coef")


def q_explained_variance(spark, sf_dir):
    """Given predictions (a supplier's nation mean) scored against each supplier."""
    s_ = (table(spark, sf_dir, "supplier")
          .select(F.col("s_suppkey").cast("string").alias("region"), F.col("s_nationkey"),
                  (F.col("s_acctbal") / 10000).alias("share")))
    means = s_.groupBy("s_nationkey").agg(F.avg("share").alias("prediction"))
    scored = s_.join(means, "s_nationkey")
    return _r(M.explained_variance(scored), "explained_variance")


def q_top_coefficients(spark, sf_dir):
    """P12 + K4: largest ridge coefficients after the name-prefix filter."""
    df, names = _regression_frame(spark, sf_dir)
    ridge = M.ridge_cv(df, folds=3)
    coefs = M.coefficient_table(ridge, names)
    kept = M.prefix_filter(coefs, ["l_linenumber_7"])
    return M.top_coefficients(kept, 19)


def q_drop_collinear(spark, sf_dir):
    """F7 + F5: linear embedding without the first level of each one-hot block."""
    p, s = _stats(spark, sf_dir)
    e = embed.linear_embedding(p, s)
    return _r(embed.drop_collinear(e, s).values, "value")


def q_only_features(spark, sf_dir):
    """Feature selection with ``only`` (allocation flags then included)."""
    p, s = _stats(spark, sf_dir)
    from regemb.spec import skip_features
    skip = skip_features(STANDIN, only=["l_tax", "o_orderstatus"])
    return _r(embed.linear_embedding(p, s, skip=skip).values, "value")


def q_category_join(spark, sf_dir):
    """Code -> category by a join with the code table (nations and their regions)."""
    lk = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"),
                                               F.col("n_regionkey").alias("cat_code"))
    codes = table(spark, sf_dir, "part").withColumn(
        "size_code", F.lpad(F.col("p_size").cast("string"), 4, "0"))
    j = R.degree_category_join(codes, "size_code", lk, out="cat")
    return j.groupBy("cat").agg(F.count(F.lit(1)).alias("n"),
                                F.sum("p_size").alias("size_sum"))


def q_two_party_share(spark, sf_dir):
    """Trials, successes and share from the region x party table."""
    return _r(M.two_party_target(q_votes_by_region(spark, sf_dir)), "share")


def q_bandwidth_heuristic(spark, sf_dir):
    """K1 + F6 + M3: median-heuristic bandwidth of the encoded person sample."""
    s = st.compute_stats(_keyed_person(spark, sf_dir), STANDIN, sample_size=2000,
                         sample_key_col=PERSON_KEY)
    bw = distances.median_heuristic_bandwidth(s)
    return _r(spark.createDataFrame([(float(bw),)], "bandwidth double"), "bandwidth")


def q_superregions(spark, sf_dir):
    """U7 + G4: components over two eras' county -> region edges, named per state."""
    era1 = q_region_names(spark, sf_dir).select(F.col("key").alias("county"), "region")
    c = table(spark, sf_dir, "customer")
    nat = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    era2 = c.select(F.concat(nat, F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
                    .alias("county"),
                    F.concat(nat, F.lit("_"), F.col("c_mktsegment")).alias("region"))
    m = graph.superregions([era1, era2], "county", "region")
    m = m.withColumn("st", F.when(F.col("side") == "left", F.substring("key", 1, 2)))
    names = graph.name_regions(m, "st", "merged")
    return graph.membership(m, names)["left"]


def q_stream_embedding(spark, sf_dir):
    """A8 on a stream: yearly files of persons arrive; the embedding is kept as
    streaming sums and equals the batch embedding when all have arrived."""
    from regemb.streaming import incremental
    p, s = _stats(spark, sf_dir)
    src = scratch_path(spark, "stream-src")
    p.repartition("batch").write.parquet(src)
    out = scratch_path(spark, "stream-out")
    e = incremental.run_to_completion(spark, src, spark.read.parquet(src).schema, s, out,
                                      files_per_trigger=2)
    return _r(e.values, "value")


# --- one pass, additive extras, dense results --------------------------------

ONE_TAX = rff.gaussian_freqs(1, 4, bandwidth=0.7, seed=12)
EXTRAS = FZ.ExtrasConfig(reals=["l_extendedprice", "l_tax"],
                         discretes=["l_returnflag", "l_linestatus"],
                         freqs={("l_extendedprice",): ONE, ("l_tax",): ONE_TAX,
                                ("l_extendedprice", "l_tax"): PAIR})


def q_extra_catalogue(spark, sf_dir):
    """F8 + X4: names, ids, offsets and keep flags of the additive vector."""
    _, s = _stats(spark, sf_dir)
    blocks = FZ.extra_blocks(s, EXTRAS, FZ.extra_freqs(s, EXTRAS))
    return FZ.extra_catalogue(s, blocks).select("pos", "feature_name", "feature_id", "level", "keep")


def q_additive_extras(spark, sf_dir):
    """X4 + A11-A14: the additive extras as one vector."""
    p, s = _stats(spark, sf_dir)
    return _r(FZ.additive_extras(p, s, EXTRAS).values, "value")


def q_featurize_all(spark, sf_dir):
    """Linear means, RFF and extras of every region from one scan."""
    p, s = _stats(spark, sf_dir)
    out = FZ.featurize(p, s, rff_config=FZ.RFFConfig(freqs=_freqs(s)), extras_config=EXTRAS)
    cols = ["region", "subset", "pos", "feature_name", "feature_id", "value"]
    return _r(setops.union_all([e.values.select(*cols, F.lit(k).alias("kind"))
                                for k, e in out.items()]), "value")


def q_rff_conditional_subsets(spark, sf_dir):
    """A13 by subset: levels that a subset leaves out have zeros."""
    p, s = _stats(spark, sf_dir)
    e = rff.real_rff_embedding(p, s, ["l_extendedprice"], ONE, condition="l_returnflag",
                               subsets=SUBSETS)
    return _r(e.values, "value")


EMPTY_SUBSETS = [*SUBSETS, "l_quantity < 0"]


def q_subset_weights_empty(spark, sf_dir):
    """A subset without rows weighs 0 in every region."""
    p = person(spark, sf_dir)
    return _r(embed.region_weights(p, STANDIN.weight, subsets=EMPTY_SUBSETS), "weight")


def q_block_bandwidths(spark, sf_dir):
    """M5: a bandwidth for each real and each real pair, from one read of the sample."""
    s = st.compute_stats(_keyed_person(spark, sf_dir), STANDIN, sample_size=1000,
                         sample_key_col=PERSON_KEY)
    reals = ["l_extendedprice", "l_tax"]
    groups = [["l_extendedprice"], ["l_tax"], reals]
    widths = distances.block_bandwidths(s, reals, groups)
    return _r(spark.createDataFrame([("_".join(g), float(w)) for g, w in zip(groups, widths)],
                                    "block string, bandwidth double"), "bandwidth")


def q_keyless_sample(spark, sf_dir):
    """K1 without a key: equal rows are told apart by their number."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("qty"))
    return st.weighted_sample(li, "qty", 500)


# --- sources and sinks over files written from the tables ----------------------


def _csv_parts(spark, sf_dir):
    """Orders as two CSV files whose columns come in another order."""
    base = scratch_path(spark, "csv")
    o = table(spark, sf_dir, "orders")
    cols = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    text = o.select(*[F.col(c).cast("string").alias(c) for c in cols])
    even = F.col("o_orderkey").cast("long") % 2 == 0
    text.where(even).select(*cols).write.option("header", True).csv(f"{base}/a")
    text.where(~even).select(*reversed(cols)).write.option("header", True).csv(f"{base}/b")
    return base


CSV_SPEC = STANDIN.__class__(name="orders-csv", weight="o_totalprice",
                             discrete=("o_orderstatus", "o_orderpriority"), meta=("o_orderkey",))


def q_csv_by_name(spark, sf_dir):
    """S1 + S2: a folder of CSV files with shuffled headers, bound by name."""
    df = microdata.read_csv(spark, _csv_parts(spark, sf_dir), CSV_SPEC)
    return _r(df.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price")), "price", digits=2)


def q_csv_bad_values(spark, sf_dir):
    """Texts that should be weights and are none, listed."""
    raw = microdata.read_text(spark, _csv_parts(spark, sf_dir)).withColumn(
        "o_totalprice", F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("n/a "),
                                                                      F.col("o_orderpriority")))
        .otherwise(F.col("o_totalprice")))
    return microdata.bad_values(raw, CSV_SPEC)


def q_lookup_files(spark, sf_dir):
    """S12 + J3: a geography lookup read from CSV, its super-regions from Parquet."""
    base = scratch_path(spark, "lookups")
    region_lookup(spark, sf_dir).write.option("header", True).csv(f"{base}/places.csv")
    superregion_lookup(spark, sf_dir).write.parquet(f"{base}/super")
    places = lookups.read_lookup(spark, f"{base}/places.csv")
    known = lookups.read_lookup(spark, f"{base}/super").select("region")
    p = regions.assign_region(person(spark, sf_dir, with_region=False), places, on=["st"])
    return _r(embed.region_weights(p.join(known, "region", "left_semi"), STANDIN.weight), "weight")


HOUSING_SPEC = STANDIN.__class__(
    name="housing-costs", weight="w", real=("cost", "income"), discrete=("TYPE",), meta=("st",),
    adjust={"ADJHSG": ("cost",), "ADJINC": ("income",)}, renames={"c_mktsegment": "TYPE"})


def q_housing_costs(spark, sf_dir):
    """P5 + P6 + P7: housing costs and incomes by their own factors."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    raw = o.join(c, o.o_custkey == c.c_custkey).select(
        F.lit(1.0).alias("w"), F.col("c_nationkey").alias("st"), "c_mktsegment",
        F.col("o_totalprice").alias("cost"), F.col("c_acctbal").alias("income"),
        (1000000 + 10000 * (2001 - F.year("o_orderdate"))).alias("ADJHSG"),
        (1000000 + 5000 * F.month("o_orderdate")).alias("ADJINC"))
    out = clean.clean(raw, HOUSING_SPEC)
    clean.check_schema(out, HOUSING_SPEC)
    return _r(out.groupBy("st", "TYPE").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.sum("income").alias("income"),
        F.max("ADJINC_orig").alias("max_factor")), "cost", "income", digits=2)


def q_housing_partitions(spark, sf_dir):
    """U2 + J1: housing rows in three parts, one of them CSV, joined to persons."""
    base = scratch_path(spark, "housing")
    h = household_rows(spark, sf_dir).select("l_orderkey", "st", "o_orderstatus")
    part = F.pmod(F.col("l_orderkey"), F.lit(3))
    h.where(part == 0).write.parquet(f"{base}/0")
    h.where(part == 1).select("o_orderstatus", "l_orderkey", "st").write.parquet(f"{base}/1")
    (h.where(part == 2).select(*[F.col(c).cast("string") for c in ("st", "o_orderstatus", "l_orderkey")])
      .write.option("header", True).csv(f"{base}/2.csv"))
    spec = STANDIN.__class__(name="housing-parts", weight="st", discrete=("o_orderstatus",),
                             meta=("l_orderkey",))
    rows = microdata.read_partitions(spark, [f"{base}/{i}" for i in ("0", "1", "2.csv")], spec)
    j = clean.join_housing(person_lines(spark, sf_dir),
                           rows.withColumn("l_orderkey", F.col("l_orderkey").cast("long")),
                           key="l_orderkey")
    return _r(j.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                             F.sum("l_quantity").alias("wt")), "wt")


SORT_SPEC = replace(STANDIN, adjust={"adjinc": ("l_tax",)})


def _sorted(spark, sf_dir, **kw):
    raw = person(spark, sf_dir, with_region=False).drop("batch")
    base = scratch_path(spark, "sort-job")
    res = sort_by_region(raw, SORT_SPEC, region_lookup(spark, sf_dir), ["st"],
                         out_path=f"{base}/regions", stats_path=f"{base}/stats",
                         voters_only=False, sample_size=0, **kw)
    return base, res


def q_sort_job(spark, sf_dir):
    """S3 + S4 + P1 + P6: the sort job's partitions, read back with a column list."""
    base, _ = _sorted(spark, sf_dir)
    df = microdata.read_parquet(spark, f"{base}/regions",
                                ["region", "l_quantity", "l_tax", "adjinc_orig"])
    return _r(df.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("wt"),
        F.sum("l_tax").alias("tax_adj"), F.max("adjinc_orig").alias("max_factor")),
        "wt", "tax_adj")


def q_stats_roundtrip(spark, sf_dir):
    """S5 + S6: the stored stats bundle, read back."""
    base, _ = _sorted(spark, sf_dir, stats_only=True)
    s = sinks.load_stats(spark, f"{base}/stats", SORT_SPEC)
    counts = s.value_counts.select("feature", "level", "cnt", F.lit(None).cast("double").alias("mean"))
    reals = s.reals.select("feature", F.lit(None).cast("string").alias("level"), "cnt", "mean")
    return _r(counts.unionByName(reals), "mean")


def q_embedding_roundtrip(spark, sf_dir):
    """S7 + S8 + X1: a preprocessed embedding, saved, loaded and rolled up."""
    p = person(spark, sf_dir)
    big = replace(STANDIN, discrete=("l_returnflag", "big"))
    out = FZ.featurize(p, st.compute_stats(p, STANDIN, sample_size=0), spec=big,
                       preprocessor=lambda d: d.withColumn(
                           "big", (F.col("l_extendedprice") > 50000).cast("string")))
    path = scratch_path(spark, "embedding")
    sinks.save_embedding(out["lin"], path)
    back = sinks.load_embedding(spark, path)
    return _r(back.values.where(F.col("feature_id") == "big").join(
        back.weights, ["region", "subset"]).select(
        "region", "feature_name", "value", "weight"), "value", "weight")


def q_export_wide(spark, sf_dir):
    """S9 + S10: the wide CSV of an embedding and the CSV of region weights, read back."""
    _, s, e = _lin(spark, sf_dir)
    names = [r[1] for r in encode.catalogue_rows(s, skip_features(STANDIN))]
    path = scratch_path(spark, "export")
    sinks.export_wide(e, names, f"{path}/wide.csv")
    sinks.write_region_weights(e, f"{path}/weights.csv")
    wide = spark.read.option("header", True).csv(f"{path}/wide.csv")
    w = spark.read.option("header", True).csv(f"{path}/weights.csv")
    cells = F.array(*[F.struct(F.lit(n).alias("feature_name"),
                               F.col(n).cast("double").alias("value")) for n in names])
    return _r(wide.select("region", F.inline(cells)).join(w, "region").withColumn(
        "total_wt", F.col("total_wt").cast("double")), "value", "total_wt")


# --- census profiles -------------------------------------------------------------

CENSUS_COUNTED = ["ANYHISP", "ETHNICITY", "HASDEGREE", "NAICSP", "OCCP", "MIL", "LANP", "ANC1P",
                  "ANC2P", "RAC2P", "SCHL", "SCHG", "FER"]


def _census(spark, sf_dir, version, common, columns, also_keep=("ANC2P",)):
    lookup = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"),
                                                   F.col("n_regionkey").alias("cat_code"))
    profile = CP.census_profile(version, common, also_keep, degree_lookup=lookup)
    return CP.code_counts(profile.apply(census_rows(spark, sf_dir, version)), columns)


def q_census_old(spark, sf_dir):
    """O24 of an old file: O2, O3, old language and ancestry (O13, O14), service, race."""
    return _census(spark, sf_dir, "2006-10", True, CENSUS_COUNTED)


def q_census_common(spark, sf_dir):
    """O24 of a new file in the old files' codes."""
    return _census(spark, sf_dir, "2014-18", True, CENSUS_COUNTED)


def q_census_full(spark, sf_dir):
    """O24 of a new file as it is, field of degree by category."""
    return _census(spark, sf_dir, "2014-18", False, [*CENSUS_COUNTED, "FOD1P"])


def _census_sql(old: bool, common: bool) -> str:
    schl = _sql_map("SCHL", R.SCHL_NEW_TO_OLD) if common and not old else "SCHL"
    anc = R.ANCP_OLD_TO_COMMON if old else R.ANCP_NEW_TO_OLD
    lan = R.LANP_OLD_TO_COMMON if old else R.LANP_NEW_TO_OLD
    changed = common or old
    cols = {
        "ANYHISP": "CAST(CAST(coalesce(TRY_CAST(HISP AS INTEGER) > 1, FALSE) AS INTEGER) AS VARCHAR)",
        "ETHNICITY": _sql_eth("HISP", "RAC1P"),
        "HASDEGREE": "CAST(" + _sql_deg(schl, 12 if changed else 20) + " AS VARCHAR)",
        "NAICSP": _sql_sector("coalesce(naicsp07, naicsp02)" if old else "NAICSP"),
        "OCCP": _sql_occ("coalesce(occp10, occp02)" if old else "OCCP"),
        "MIL": _sql_map("MIL", R.MIL_OLD_TO_NEW) if old else "MIL",
        "LANP": _sql_remap_identity("LANP", lan) if changed else "LANP",
        "ANC1P": _sql_remap_identity("ANC1P", anc) if changed else "ANC1P",
        "ANC2P": _sql_remap_identity("ANC2P", anc) if changed else "ANC2P",
        "RAC2P": (_sql_map("RAC2P", R.RAC2P_OLD if old else R.RAC2P_NEW) if changed else "RAC2P"),
        "SCHL": schl,
        "SCHG": _sql_map("SCHG", R.SCHG_NEW_TO_OLD) if common and not old else "SCHG",
        "FER": _sql_map("FER", R.FER_NEW_TO_OLD) if common and not old else "FER"}
    if not changed:
        cols["FOD1P"] = ("(SELECT CAST(n_regionkey AS VARCHAR) FROM nation "
                         "WHERE n_nationkey = CAST(FOD1P AS INTEGER))")
    return "WITH " + census_rows_sql() + ",\nx AS (" + " UNION ALL ".join(
        f"SELECT {S.q(c)} AS feature, {e} AS level FROM census" for c, e in cols.items()
    ) + ")\nSELECT feature, level, count(*) AS n FROM x GROUP BY feature, level"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    extra = {**_llm.queries(), "pipeline": _pipeline.run} if _llm else {}
    return {**_queries(), **extra}


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "linear_embedding": q_linear_embedding,
        "region_weights": q_region_weights,
        "subset_weights": q_subset_weights,
        "subset_embedding": q_subset_embedding,
        "real_stats": q_real_stats,
        "value_counts": q_value_counts,
        "totals": q_totals,
        "needs_nan": q_needs_nan,
        "catalogue": q_catalogue,
        "thermometer": q_thermometer,
        "interactions": q_interactions,
        "weighted_sample": q_weighted_sample,
        "person_sample": q_person_sample,
        "median_ties": q_median_ties,
        "rff_embedding": q_rff_embedding,
        "rff_one_real": q_rff_one_real,
        "rff_real_pair": q_rff_real_pair,
        "rff_conditional": q_rff_conditional,
        "median_heuristic": q_median_heuristic,
        "batch_merge_embedding": q_batch_merge_embedding,
        "batch_merge_moments": q_batch_merge_moments,
        "superregion_rollup": q_superregion_rollup,
        "superregion_weights": q_superregion_weights,
        "state_rollup": q_state_rollup,
        "rollup_all": q_rollup_all,
        "rollup_conditional": q_rollup_conditional,
        "clean_chain": q_clean_chain,
        "household_join": q_household_join,
        "unmapped_report": q_unmapped_report,
        "mapped_weights": q_mapped_weights,
        "state_regions": q_state_regions,
        "puma_regions": q_puma_regions,
        "coverage": q_coverage,
        "set_ops": q_set_ops,
        "set_equal": q_set_equal,
        "components": q_components,
        "region_names": q_region_names,
        "forced_merge": q_forced_merge,
        "recodes": q_recodes,
        "recode_profile": q_recode_profile,
        "regroup_counts": q_regroup_counts,
        "top_candidates": q_top_candidates,
        "votes_by_party": q_votes_by_party,
        "votes_by_region": q_votes_by_region,
        "precinct_rollup": q_precinct_rollup,
        "cartesian": q_cartesian,
        "centroids": q_centroids,
        "spatial_features": q_spatial_features,
        "regression": q_regression,
        "explained_variance": q_explained_variance,
        "top_coefficients": q_top_coefficients,
        "drop_collinear": q_drop_collinear,
        "only_features": q_only_features,
        "category_join": q_category_join,
        "two_party_share": q_two_party_share,
        "bandwidth_heuristic": q_bandwidth_heuristic,
        "superregions": q_superregions,
        "stream_embedding": q_stream_embedding,
        "shared_pass": q_shared_pass,
        "custom_featurizer": q_custom_featurizer,
        "extras_one_pass": q_extras_one_pass,
        "rff_thermometer": q_rff_thermometer,
        "ridge_fixed": q_ridge_fixed,
        "ridge_scores": q_ridge_scores,
        "ridge_top": q_ridge_top,
        "extra_catalogue": q_extra_catalogue,
        "additive_extras": q_additive_extras,
        "featurize_all": q_featurize_all,
        "rff_conditional_subsets": q_rff_conditional_subsets,
        "subset_weights_empty": q_subset_weights_empty,
        "block_bandwidths": q_block_bandwidths,
        "keyless_sample": q_keyless_sample,
        "csv_by_name": q_csv_by_name,
        "csv_bad_values": q_csv_bad_values,
        "housing_partitions": q_housing_partitions,
        "housing_costs": q_housing_costs,
        "lookup_files": q_lookup_files,
        "sort_job": q_sort_job,
        "stats_roundtrip": q_stats_roundtrip,
        "embedding_roundtrip": q_embedding_roundtrip,
        "export_wide": q_export_wide,
        "census_old": q_census_old,
        "census_common": q_census_common,
        "census_full": q_census_full,
    }


# --- oracle SQL --------------------------------------------------------------


def _no_negative_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB rounds tiny
    negatives to -0.0 where Spark gives 0.0, and the two hash differently."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        while j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            j = low.find("round(", j + 6)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = _no_negative_zero(sql[j + 6:k - 1])
        out.append(f"{sql[i:j]}(round({inner}) + 0.0)")
        i = k


def oracle_sql() -> dict[str, str]:
    own = {k: _no_negative_zero(v) for k, v in _oracle_sql().items()}
    extra = dict(_llm.oracle_sql()) if _llm else {}
    if _pipeline and _pipeline.ORACLE_SQL:
        extra["pipeline"] = _pipeline.ORACLE_SQL
    return {**own, **extra}


def _oracle_sql() -> dict[str, str]:
    stats_only = S.with_person(S.stats_ctes())
    hu = S.hash_uniform_sql("o_orderkey")
    return {
        "linear_embedding": S.linear_sql(),
        "region_weights": S.linear_sql(weight_out=True),
        "subset_weights": S.linear_sql(subsets=SUBSETS_SQL, weight_out=True),
        "subset_embedding": S.linear_sql(subsets=SUBSETS_SQL),
        "real_stats": stats_only + "\nSELECT feature, cnt, round(mean, 6) AS mean, "
                                   "round(std, 6) AS std FROM rstats",
        "value_counts": stats_only + "\nSELECT feature, level, cnt FROM vc",
        "totals": stats_only + "\nSELECT n_total, round(wt_total, 6) AS wt_total FROM tot",
        "needs_nan": stats_only + "\nSELECT feature, needs_nan FROM nn",
        "catalogue": S.with_person(S.stats_ctes() + ",\n" + S.catalogue_cte()
                                   + "\nSELECT pos, feature_name, feature_id, feature, level, "
                                     "keep FROM cat"),
        "thermometer": S.linear_sql(ordered=THERMO, only_features=list(THERMO)),
        "interactions": S.linear_sql(subsets=SUBSETS_SQL, pairs=PAIRS),
        "weighted_sample": f"""
WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) + 1 AS BIGINT) AS w FROM orders)
SELECT o_orderkey, w FROM o
ORDER BY CASE WHEN w > 0 THEN -ln({hu}) / w ELSE 'inf'::DOUBLE END, o_orderkey
LIMIT 500""",
        "rff_embedding": S.rff_sql(FREQS.tolist(), full=True),
        "rff_one_real": S.rff_sql(ONE.tolist(), ["l_extendedprice"]),
        "rff_real_pair": S.rff_sql(PAIR.tolist(), ["l_extendedprice", "l_tax"]),
        "rff_conditional": S.rff_sql(ONE.tolist(), ["l_extendedprice"], condition="l_returnflag"),
        "median_heuristic": f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
                  {S.hash_uniform_sql('vec_id')} AS u FROM embeddings),
s AS (SELECT vec_id, v FROM e ORDER BY -ln(u) / 1.0, vec_id LIMIT 5000),
p AS (SELECT list_distance(a.v, b.v) AS d FROM s a JOIN s b ON a.vec_id < b.vec_id)
SELECT (SELECT count(*) FROM s) AS n_points, count(*) AS n_pairs,
       round(median(d * d), 6) AS median_sq_dist, round(sqrt(median(d * d)), 6) AS bandwidth
FROM p""",
        "median_ties": f"""
WITH s AS (SELECT o_orderkey AS k, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS v FROM orders
           ORDER BY -ln({hu}), o_orderkey LIMIT 5000),
p AS (SELECT (a.v - b.v) * (a.v - b.v) AS d FROM s a JOIN s b ON a.k < b.k)
SELECT (SELECT count(*) FROM s) AS n_points, count(*) AS n_pairs,
       round(median(d), 6) AS median_sq_dist, round(sqrt(median(d)), 6) AS bandwidth FROM p""",
        "person_sample": S.with_person(KEYED_PERSON_SQL.format(n=500)
                                       + "\nSELECT " + ", ".join(PERSON_KEY) + " FROM samp"),
        "bandwidth_heuristic": S.with_person(
            S.stats_ctes() + "," + KEYED_PERSON_SQL.format(n=2000) + f""",
x AS (SELECT row_number() OVER () AS i, {S.z_expr('l_extendedprice')} AS z0,
             {S.z_expr('l_discount')} AS z1, {S.z_expr('l_tax')} AS z2,
             l_returnflag AS a, l_linestatus AS b, l_linenumber AS c FROM samp),
d AS (SELECT (s.z0 - t.z0) * (s.z0 - t.z0) + (s.z1 - t.z1) * (s.z1 - t.z1)
             + (s.z2 - t.z2) * (s.z2 - t.z2)
             + 2 * (CAST(s.a IS DISTINCT FROM t.a AS INTEGER)
                    + CAST(s.b IS DISTINCT FROM t.b AS INTEGER)
                    + CAST(s.c IS DISTINCT FROM t.c AS INTEGER)) AS d
      FROM x s JOIN x t ON s.i < t.i)
SELECT round(sqrt(median(d)), 6) AS bandwidth FROM d"""),
        "batch_merge_embedding": S.linear_sql(),
        "batch_merge_moments": stats_only + "\nSELECT feature, cnt, round(mean, 6) AS mean, "
                                            "round(std, 6) AS std FROM rstats",
        "superregion_rollup": S.linear_sql(region_expr="r.r_name"),
        "superregion_weights": S.linear_sql(region_expr="r.r_name", weight_out=True),
        "state_rollup": S.linear_sql(region_expr="substr(n.n_name, 1, 2)"),
        "rollup_all": "SELECT *, 'lin' AS kind FROM (" + S.linear_sql(region_expr="r.r_name")
                      + ") UNION ALL " + "SELECT * FROM ("
                      + S.rff_sql(FREQS.tolist(), full=True, region_expr="r.r_name", kind="rff")
                      + ")",
        "rollup_conditional": S.rff_sql(ONE.tolist(), ["l_extendedprice"], condition="l_returnflag",
                                        region_expr="r.r_name"),
        "clean_chain": S.with_person("""
raw AS (SELECT *, CASE WHEN l_linenumber = '7' THEN -9 ELSE st END AS puma10,
               CAST(l_linenumber AS INTEGER) * 6 AS agep,
               CASE o_orderstatus WHEN 'F' THEN '5' WHEN 'P' THEN 'b' END AS cit FROM person)
SELECT puma10 AS PUMA, l_returnflag AS RFLAG, count(*) AS n, round(sum(l_quantity), 6) AS wt,
       round(sum(l_extendedprice * adjinc / 1e6), 6) AS price_adj,
       round(sum(l_tax * adjinc / 1e6), 6) AS tax_adj,
       CAST(max(adjinc) AS INTEGER) AS max_factor
FROM raw
WHERE puma10 IS DISTINCT FROM -9 AND agep >= 18 AND TRY_CAST(cit AS INTEGER) IS DISTINCT FROM 5
GROUP BY 1, 2"""),
        "household_join": S.with_person("""
x AS (SELECT 1)
SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 6) AS wt FROM person GROUP BY 1"""),
        "unmapped_report": S.with_person("""
x AS (SELECT 1)
SELECT st, l_linenumber, count(*) AS count FROM person WHERE st = 0 GROUP BY 1, 2"""),
        "mapped_weights": S.with_person("""
x AS (SELECT 1)
SELECT region, 0 AS subset, round(sum(l_quantity), 6) AS weight FROM person WHERE st <> 0
GROUP BY 1"""),
        "state_regions": S.with_person("""
x AS (SELECT 1)
SELECT 'N' || lpad(CAST(st AS VARCHAR), 2, '0') AS region, 0 AS subset,
       round(sum(l_quantity), 6) AS weight FROM person GROUP BY 1""", "n.n_name"),
        "puma_regions": S.with_person("""
x AS (SELECT 1)
SELECT 'N' || lpad(CAST(st AS VARCHAR), 2, '0') || '_' || l_linenumber AS region, 0 AS subset,
       round(sum(l_quantity), 6) AS weight FROM person GROUP BY 1"""),
        "coverage": """
WITH d AS (SELECT l_returnflag AS f, l_linenumber AS l,
                  CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS k
           FROM lineitem),
a AS (SELECT CASE WHEN l <> 7 THEN k END AS k FROM d WHERE f = 'N'),
b AS (SELECT k FROM d WHERE f <> 'N')
SELECT k, CAST(1 AS BIGINT) AS n, 'left_only' AS side
FROM (SELECT DISTINCT k FROM a WHERE k IS NULL OR k NOT IN (SELECT k FROM b WHERE k IS NOT NULL))
UNION ALL
SELECT k, 1, 'right_only'
FROM (SELECT DISTINCT k FROM b WHERE k IS NULL OR k NOT IN (SELECT k FROM a WHERE k IS NOT NULL))
UNION ALL
SELECT NULL, count(*), 'left_null' FROM a WHERE k IS NULL HAVING count(*) > 0""",
        "explained_variance": """
WITH s AS (SELECT s_acctbal / 10000 AS y,
                  avg(s_acctbal / 10000) OVER (PARTITION BY s_nationkey) AS p FROM supplier)
SELECT round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance FROM s""",
        "set_ops": """
WITH u AS (SELECT c_nationkey AS k, 'c' AS src FROM customer
           UNION ALL SELECT s_nationkey, NULL FROM supplier),
a AS (SELECT * FROM u UNION ALL SELECT 77777, src FROM u WHERE k IN (1, 2))
SELECT DISTINCT k, coalesce(src, 's') AS src FROM a""",
        "set_equal": """
SELECT (SELECT count(DISTINCT c_nationkey) FROM customer) AS n_customer_nations,
       NOT EXISTS (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
       AND NOT EXISTS (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)
       AS same""",
        "components": "WITH RECURSIVE " + PAIRS_SQL.strip() + "\nSELECT side, key, component FROM comp",
        "region_names": "WITH RECURSIVE " + PAIRS_SQL.strip() + """,
cs AS (SELECT component, min(substr(key, 1, 2)) AS st,
              min(CASE WHEN side = 'left' THEN key END) AS first_key FROM comp GROUP BY component),
named AS (SELECT component, 'N' || st || '_00_'
                 || lpad(CAST(row_number() OVER (PARTITION BY st ORDER BY first_key, component)
                              AS VARCHAR), 2, '0') AS region FROM cs)
SELECT key, region FROM comp JOIN named USING (component) WHERE side = 'left'""",
        "recodes": "WITH " + CODES_SQL + f"""
SELECT o_orderkey, {_sql_sector('NAICSP')} AS sector,
       {_sql_sector('coalesce(naicsp07, naicsp02)')} AS sector_old,
       {_sql_eth('HISP', 'RAC1P')} AS ethnicity,
       CAST(coalesce(TRY_CAST(HISP AS INTEGER) > 1, FALSE) AS INTEGER) AS anyhisp,
       {_sql_occ('OCCP')} AS occ, {_sql_deg('SCHL', 20)} AS hasdegree,
       {_sql_deg(_sql_map('SCHL', R.SCHL_NEW_TO_OLD), 12)} AS hasdegree_common,
       {_sql_map('SCHL', R.SCHG_NEW_TO_OLD)} AS schg, {_sql_map('SCHL', R.SCHL_NEW_TO_OLD)} AS schl,
       {_sql_map('HISP', R.MIL_OLD_TO_NEW)} AS mil, {_sql_map('FER', R.FER_NEW_TO_OLD)} AS fer,
       {_sql_remap_identity('LANP', R.LANP_NEW_TO_OLD)} AS lanp,
       {_sql_remap_identity('ANC1P', R.ANCP_NEW_TO_OLD)} AS anc1p,
       {_sql_map('RAC2P', R.RAC2P_NEW)} AS rac2p_new, {_sql_map('RAC2P', R.RAC2P_OLD)} AS rac2p_old
FROM codes""",
        "recode_profile": "WITH " + CODES_SQL + f"""
SELECT {_sql_eth('HISP', 'RAC1P')} AS ETHNICITY,
       CAST(coalesce(TRY_CAST(HISP AS INTEGER) > 1, FALSE) AS INTEGER) AS ANYHISP,
       {_sql_deg('SCHL', 20)} AS HASDEGREE, {_sql_sector('NAICSP')} AS NAICSP, count(*) AS n
FROM codes GROUP BY 1, 2, 3, 4""",
        "regroup_counts": "WITH " + CODES_SQL + f"""
SELECT 'SCHL' AS feature, {_sql_map('SCHL', R.SCHL_NEW_TO_OLD)} AS level, count(*) AS cnt
FROM codes WHERE {_sql_map('SCHL', R.SCHL_NEW_TO_OLD)} IS NOT NULL GROUP BY 1, 2""",
        "top_candidates": "WITH " + _votes_sql() + """
SELECT cand, CAST(sum(votes) AS BIGINT) AS votes FROM crp GROUP BY cand
ORDER BY votes DESC, cand LIMIT 50""",
        "votes_by_party": "WITH " + _votes_sql() + """
SELECT party, CAST(sum(votes) AS BIGINT) AS votes FROM crp GROUP BY party""",
        "votes_by_region": "WITH " + _votes_sql() + """
SELECT n_name AS region,
       CAST(coalesce(sum(CASE WHEN party = 'D' THEN votes END), 0) AS BIGINT) AS votes_D,
       CAST(coalesce(sum(CASE WHEN party = 'R' THEN votes END), 0) AS BIGINT) AS votes_R,
       CAST(coalesce(sum(CASE WHEN party = 'L' THEN votes END), 0) AS BIGINT) AS votes_L,
       CAST(coalesce(sum(CASE WHEN party = 'G' THEN votes END), 0) AS BIGINT) AS votes_G,
       CAST(coalesce(sum(CASE WHEN party = 'oth' THEN votes END), 0) AS BIGINT) AS votes_oth
FROM crp JOIN supplier ON fips = lpad(CAST(s_suppkey AS VARCHAR), 5, '0')
JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
        "precinct_rollup": "WITH " + _votes_sql() + """
SELECT '99999' AS fips, 'All events' AS county, event_type AS candidate,
       CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS votes, 'ev' AS state
FROM events GROUP BY event_type
UNION ALL
SELECT fips, NULL, NULL, CAST(sum(votes) AS BIGINT), 'li' FROM crp GROUP BY fips""",
        "cartesian": """
SELECT s_suppkey,
       round(6371.0 * sin(radians(s_acctbal / 200)) * cos(radians(s_acctbal / 100)), 6) AS x,
       round(6371.0 * sin(radians(s_acctbal / 200)) * sin(radians(s_acctbal / 100)), 6) AS y,
       round(6371.0 * cos(radians(s_acctbal / 200)), 6) AS z
FROM supplier""",
        "centroids": "WITH " + CENTROID_SQL + """
SELECT region, round(lon, 6) AS lon, round(lat, 6) AS lat, round(area, 6) AS area FROM cen""",
        "spatial_features": _spatial_sql(),
        "stream_embedding": S.linear_sql(),
        "rff_thermometer": S.rff_sql(FREQS.tolist(), full=True, ordered=THERMO),
        "extras_one_pass": "SELECT *, CAST(NULL AS VARCHAR) AS level FROM ("
                           + S.rff_sql(ONE.tolist(), ["l_extendedprice"])
                           + ") UNION ALL SELECT *, CAST(NULL AS VARCHAR) FROM ("
                           + S.rff_sql(PAIR.tolist(), ["l_extendedprice", "l_tax"])
                           + ") UNION ALL SELECT * FROM ("
                           + S.rff_sql(ONE.tolist(), ["l_extendedprice"],
                                       condition="l_returnflag") + ")",
        "custom_featurizer": S.with_person(S.stats_ctes() + f""",
zz AS (SELECT region, coalesce(CAST(l_quantity AS DOUBLE), 0.0) AS w,
              {S.z_expr('l_extendedprice')} AS z0, {S.z_expr('l_discount')} AS z1,
              {S.z_expr('l_tax')} AS z2 FROM person),
agg AS (SELECT region, sum(w) AS wt, sum(w * z0) AS a0, sum(w * z0 * z1) AS a1,
               sum(w * z2 * z2) AS a2 FROM zz GROUP BY region)
SELECT region, 0 AS subset, 0 AS pos, 'custom_0' AS feature_name, 'custom' AS feature_id,
       round(CASE WHEN wt = 0 THEN 0.0 ELSE a0 / wt END, 6) AS value FROM agg
UNION ALL SELECT region, 0, 1, 'custom_1', 'custom',
       round(CASE WHEN wt = 0 THEN 0.0 ELSE a1 / wt END, 6) FROM agg
UNION ALL SELECT region, 0, 2, 'custom_2', 'custom',
       round(CASE WHEN wt = 0 THEN 0.0 ELSE a2 / wt END, 6) FROM agg"""),
        "ridge_fixed": _ridge_sql("design") + """
SELECT '(intercept)' AS feature_name, round(b0, 6) AS coef FROM fit
UNION ALL SELECT 'l_tax', round(b1, 6) FROM fit UNION ALL SELECT 'lat', round(b2, 6) FROM fit""",
        "ridge_scores": _ridge_sql("(SELECT * FROM design WHERE part = 'train')") + """
SELECT region, part, round(y, 6) AS share, round(b0 + b1 * x1 + b2 * x2, 6) AS prediction
FROM design, fit""",
        "ridge_top": _ridge_sql("design") + """
SELECT * FROM (SELECT 'l_tax' AS feature_name, round(b1, 6) AS coef FROM fit
               UNION ALL SELECT 'lat', round(b2, 6) FROM fit) c
ORDER BY abs(coef) DESC LIMIT 1""",
        "extra_catalogue": _extras_sql(names_only=True),
        "additive_extras": _extras_sql(),
        "featurize_all": ("SELECT *, 'lin' AS kind FROM (" + S.linear_sql() + ") UNION ALL "
                          "SELECT *, 'rff' FROM (" + S.rff_sql(FREQS.tolist(), full=True)
                          + ") UNION ALL SELECT * EXCLUDE (level), 'extra' FROM ("
                          + _extras_sql() + ")"),
        "rff_conditional_subsets": S.rff_sql(ONE.tolist(), ["l_extendedprice"],
                                             condition="l_returnflag", subsets=SUBSETS_SQL),
        "subset_weights_empty": S.linear_sql(subsets=[*SUBSETS_SQL, "l_quantity < 0"],
                                             weight_out=True),
        "block_bandwidths": S.with_person(
            S.stats_ctes() + "," + KEYED_PERSON_SQL.format(n=1000) + f""",
x AS (SELECT row_number() OVER () AS i, {S.z_expr('l_extendedprice')} AS a,
             {S.z_expr('l_tax')} AS b FROM samp),
d AS (SELECT (s.a - t.a) * (s.a - t.a) AS a, (s.b - t.b) * (s.b - t.b) AS b
      FROM x s JOIN x t ON s.i < t.i)
SELECT 'l_extendedprice' AS block, round(sqrt(median(a)), 6) AS bandwidth FROM d
UNION ALL SELECT 'l_tax', round(sqrt(median(b)), 6) FROM d
UNION ALL SELECT 'l_extendedprice_l_tax', round(sqrt(median(a + b)), 6) FROM d"""),
        "keyless_sample": """
WITH li AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS qty FROM lineitem),
t AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, qty) AS copy,
             sha256('0' || chr(31) || coalesce('=' || l_returnflag, 'null') || chr(31)
                    || coalesce('=' || l_linestatus, 'null') || chr(31)
                    || coalesce('=' || CAST(qty AS VARCHAR), 'null')) AS content FROM li),
k AS (SELECT *, content || chr(31) || CAST(copy AS VARCHAR) AS k FROM t)
SELECT l_returnflag, l_linestatus, qty FROM k
ORDER BY -ln(""" + S.hash_uniform_sql("k") + """) / qty, content, copy LIMIT 500""",
        "csv_by_name": """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS price
FROM orders GROUP BY 1, 2""",
        "csv_bad_values": """
SELECT 'o_totalprice' AS "column", 'n/a ' || o_orderpriority AS value, count(*) AS count
FROM orders WHERE o_orderstatus = 'P' GROUP BY 2""",
        "housing_partitions": S.with_person("""
x AS (SELECT 1)
SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 6) AS wt FROM person GROUP BY 1"""),
        "sort_job": S.with_person("""
x AS (SELECT 1)
SELECT region, count(*) AS n, round(sum(l_quantity), 6) AS wt,
       round(sum(l_tax * adjinc / 1e6), 6) AS tax_adj, CAST(max(adjinc) AS INTEGER) AS max_factor
FROM person GROUP BY 1"""),
        "stats_roundtrip": S.with_person("""
adjusted AS (SELECT * REPLACE (l_tax * adjinc / 1e6 AS l_tax) FROM person),
""" + S.stats_ctes(source="adjusted") + """
SELECT feature, level, cnt, CAST(NULL AS DOUBLE) AS mean FROM vc
UNION ALL SELECT feature, NULL, cnt, round(mean, 6) FROM rstats"""),
        "embedding_roundtrip": S.with_person("""
b AS (SELECT region, l_quantity AS w,
             CASE WHEN l_extendedprice > 50000 THEN 'true' ELSE 'false' END AS big FROM person),
t AS (SELECT region, sum(w) AS weight FROM b GROUP BY region)
SELECT region, 'big_' || big AS feature_name, round(sum(w) / max(weight), 6) AS value,
       round(max(weight), 6) AS weight
FROM b JOIN t USING (region) GROUP BY region, big"""),
        "export_wide": "SELECT l.region, feature_name, value, weight AS total_wt FROM ("
                       + S.linear_sql() + ") l JOIN (" + S.linear_sql(weight_out=True)
                       + ") w ON l.region = w.region",
        "census_old": _census_sql(old=True, common=True),
        "census_common": _census_sql(old=False, common=True),
        "census_full": _census_sql(old=False, common=False),
        "shared_pass": "SELECT region, subset, feature_name, feature_id, value FROM ("
                       + S.linear_sql(subsets=SUBSETS_SQL) + ") UNION ALL SELECT * FROM ("
                       + S.linear_sql(subsets=SUBSETS_SQL, pairs=PAIRS) + ")",
        "drop_collinear": S.linear_sql().replace(
            "v.level IS NOT DISTINCT FROM c.level", "v.level IS NOT DISTINCT FROM c.level "
            "WHERE c.keep"),
        "only_features": S.linear_sql(skip={"l_extendedprice", "l_discount", "l_returnflag",
                                            "l_linestatus", "l_linenumber"}),
        "category_join": """
SELECT CAST(n_regionkey AS VARCHAR) AS cat, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size_sum
FROM part LEFT JOIN nation ON p_size = n_nationkey GROUP BY 1""",
        "housing_costs": """
SELECT c_nationkey AS st, c_mktsegment AS TYPE, count(*) AS n,
       round(sum(o_totalprice * (1000000 + 10000 * (2001 - year(o_orderdate))) / 1e6), 2) AS cost,
       round(sum(c_acctbal * (1000000 + 5000 * month(o_orderdate)) / 1e6), 2) AS income,
       CAST(max(1000000 + 5000 * month(o_orderdate)) AS INTEGER) AS max_factor
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
        "lookup_files": S.with_person("""
x AS (SELECT 1)
SELECT region, 0 AS subset, round(sum(l_quantity), 6) AS weight FROM person GROUP BY 1"""),
        "two_party_share": "WITH " + _votes_sql() + """,
vr AS (SELECT n_name AS region,
              CAST(coalesce(sum(CASE WHEN party = 'D' THEN votes END), 0) AS BIGINT) AS d,
              CAST(coalesce(sum(CASE WHEN party = 'R' THEN votes END), 0) AS BIGINT) AS r
       FROM crp JOIN supplier ON fips = lpad(CAST(s_suppkey AS VARCHAR), 5, '0')
       JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
SELECT region, d + r AS n, d AS y, round(d / (d + r), 6) AS share FROM vr""",
        "superregions": "WITH RECURSIVE " + PAIRS_SQL.strip() + """,
cs AS (SELECT component, min(substr(key, 1, 2)) AS st,
              min(CASE WHEN side = 'left' THEN key END) AS first_key FROM comp GROUP BY component),
named AS (SELECT component, 'N' || st || '_00_'
                 || lpad(CAST(row_number() OVER (PARTITION BY st ORDER BY first_key, component)
                              AS VARCHAR), 2, '0') AS region FROM cs),
era1 AS (SELECT key AS county, region FROM comp JOIN named USING (component)
         WHERE side = 'left'),
era2 AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-'
                || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS county,
                lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '_' || c_mktsegment AS region
         FROM customer),
e2 AS (SELECT 'L:' || county AS a, 'R:' || region AS b FROM era1
       UNION ALL SELECT 'L:' || county, 'R:' || region FROM era2),
und2 AS (SELECT a, b FROM e2 UNION SELECT b, a FROM e2),
walk2(node, root) AS (SELECT a, a FROM und2
                      UNION SELECT und2.b, walk2.root FROM walk2 JOIN und2 ON walk2.node = und2.a),
comp2 AS (SELECT CASE WHEN node LIKE 'L:%' THEN 'left' ELSE 'right' END AS side,
                 substr(node, 3) AS key, min(root) AS component FROM walk2 GROUP BY node),
cs2 AS (SELECT component, min(CASE WHEN side = 'left' THEN substr(key, 1, 2) END) AS st,
               min(CASE WHEN side = 'left' THEN key END) AS first_key
        FROM comp2 GROUP BY component),
named2 AS (SELECT component, st || '_merged_'
                  || lpad(CAST(row_number() OVER (PARTITION BY st ORDER BY first_key, component)
                               AS VARCHAR), 2, '0') AS region FROM cs2)
SELECT key, region FROM comp2 JOIN named2 USING (component) WHERE side = 'left'""",
        "forced_merge": "WITH RECURSIVE " + PAIRS_SQL.strip().replace(
            "e AS (SELECT 'L:' || county AS a, 'R:' || puma AS b FROM pairs),",
            "e AS (SELECT 'L:' || county AS a, 'R:' || puma AS b FROM pairs UNION ALL "
            "SELECT 'L:' || county, 'H:02' FROM pairs WHERE county LIKE '02-%'),") + """
SELECT substr(key, 1, 2) AS st, count(DISTINCT component) AS n_components FROM comp
WHERE side <> 'right' OR key NOT LIKE '02' GROUP BY 1""".replace(
            "WHERE side <> 'right' OR key NOT LIKE '02' ", "WHERE component IS NOT NULL AND "
            "NOT (side = 'right' AND key = '02') "),
    }


def _ridge_sql(rows: str) -> str:
    """``design(region, x1, x2, y, part)`` and the closed-form fit of two columns on ``rows``."""
    u = S.hash_uniform_sql("'4' || chr(31) || t.region")
    return S.with_person(S.stats_ctes() + "," + CENTROID_SQL + f""",
design AS (SELECT t.region, t.x1, cen.lat AS x2, t.y,
                  CASE WHEN {u} < 0.3 THEN 'test' ELSE 'train' END AS part
           FROM (SELECT region, sum(l_quantity * {S.z_expr('l_tax')}) / sum(l_quantity) AS x1,
                        avg(CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.0 END) AS y
                 FROM person GROUP BY region) t JOIN cen ON cen.region = t.region),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) AS n FROM {rows} r),
c AS (SELECT sum((x1 - m1) * (x1 - m1)) + {RIDGE_PENALTY} AS a, sum((x1 - m1) * (x2 - m2)) AS b,
             sum((x2 - m2) * (x2 - m2)) + {RIDGE_PENALTY} AS d, sum((x1 - m1) * (y - my)) AS p,
             sum((x2 - m2) * (y - my)) AS q, max(m1) AS m1, max(m2) AS m2, max(my) AS my
      FROM {rows} r, m),
b AS (SELECT (d * p - b * q) / (a * d - b * b) AS b1, (a * q - b * p) / (a * d - b * b) AS b2,
             m1, m2, my FROM c),
fit AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM b)""")


def _extras_sql(names_only: bool = False) -> str:
    """The additive vector (or its catalogue): blocks at offsets, levels by rank."""
    price, tax, flag, status = "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus"
    n = {d: f"(SELECT max(n) FROM ranked WHERE feature = {S.q(d)})" for d in (flag, status)}
    size = 2 * ONE.shape[1]
    parts, at = [], "0"
    real = "SELECT region, subset, CAST({at} + pos AS INTEGER) AS pos, feature_name, feature_id, " \
           "value, CAST(NULL AS VARCHAR) AS level, TRUE AS keep FROM ({sql})"
    for reals, f in (([price], ONE), ([tax], ONE_TAX), ([price, tax], PAIR)):
        parts.append(real.format(at=at, sql=S.rff_sql(f.tolist(), reals)))
        at += f" + {size}"
    for r, f in ((price, ONE), (tax, ONE_TAX)):
        for d in (flag, status):
            parts.append(
                f"SELECT region, subset, CAST({at} + pos * r.n + r.rk - 1 AS INTEGER), feature_name, "
                f"feature_id, value, {S.q(d + '=')} || c.level, TRUE FROM ("
                f"{S.rff_sql(f.tolist(), [r], condition=d)}) c "
                f"JOIN ranked r ON r.feature = {S.q(d)} AND r.level = c.level")
            at += f" + {size} * {n[d]}"
    parts.append(
        f"SELECT region, subset, CAST({at} + (x.rk - 1) * y.n + y.rk - 1 AS INTEGER), feature_name, "
        f"feature_id, value, CAST(NULL AS VARCHAR), x.rk > 1 OR y.rk > 1 FROM ("
        f"{S.linear_sql(pairs=[(flag, status)])}) c "
        f"JOIN ranked x ON x.feature = {S.q(flag)} JOIN ranked y ON y.feature = {S.q(status)} "
        f"AND c.feature_name = {S.q(flag + '_' + status + '_')} || x.level || '_' || y.level")
    wanted = ("DISTINCT pos, feature_name, feature_id, level, keep" if names_only
              else "region, subset, pos, feature_name, feature_id, value, level")
    return S.with_person(S.stats_ctes() + ",\n" + S.catalogue_cte(STANDIN, set())
                         + f"\nSELECT {wanted} FROM (" + " UNION ALL ".join(parts) + ") v")


def _sql_map(x: str, d: dict) -> str:
    whens = " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else S.q(str(v)))
                     for k, v in d.items())
    return f"(CASE TRY_CAST({x} AS INTEGER) {whens} END)"


def _sql_remap_identity(x: str, d: dict) -> str:
    keys = ", ".join(str(k) for k in d)
    return (f"(CASE WHEN TRY_CAST({x} AS INTEGER) IN ({keys}) THEN {_sql_map(x, d)} "
            f"WHEN TRY_CAST({x} AS INTEGER) BETWEEN 0 AND 999 "
            f"THEN CAST(TRY_CAST({x} AS INTEGER) AS VARCHAR) END)")


def _sql_sector(x: str) -> str:
    whens = " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in R.NAICS_SECTORS.items())
    return f"(CASE substr(CAST({x} AS VARCHAR), 1, 2) {whens} END)"


def _sql_occ(x: str) -> str:
    v = f"TRY_CAST({x} AS DOUBLE)"
    whens = " ".join(f"WHEN {v} >= {lo} THEN {S.q(name)}"
                     for lo, name in reversed(R.OCCUPATION_GROUPS))
    return f"(CASE WHEN {v} IS NULL THEN NULL {whens} END)"


def _sql_eth(h: str, r: str) -> str:
    return (f"(CASE WHEN TRY_CAST({h} AS INTEGER) IS DISTINCT FROM 1 THEN 'hispanic' "
            f"ELSE {_sql_map(r, R.ETHNICITY)} END)")


def _sql_deg(x: str, k: int) -> str:
    return f"CAST(coalesce(TRY_CAST({x} AS INTEGER) >= {k}, FALSE) AS INTEGER)"


CODES_SQL = """codes AS (
  SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS HISP,
         CAST(month(o_orderdate) AS VARCHAR) AS RAC1P,
         CAST(day(o_orderdate) AS VARCHAR) AS SCHL,
         CAST(month(o_orderdate) + day(o_orderdate) AS VARCHAR) AS RAC2P,
         CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '8' END AS FER,
         CAST(day(o_orderdate) * 7 AS VARCHAR) AS ANC1P,
         CAST(day(o_orderdate) * 7 + 560 AS VARCHAR) AS LANP,
         lpad(CAST(day(o_orderdate) * 3 AS VARCHAR), 2, '0') AS NAICSP,
         CASE WHEN o_orderstatus <> 'P' THEN lpad(CAST(day(o_orderdate) * 3 AS VARCHAR), 2, '0')
         END AS naicsp07,
         lpad(CAST(month(o_orderdate) * 4 AS VARCHAR), 2, '0') AS naicsp02,
         CAST(CAST(trunc(o_totalprice / 50) AS INTEGER) AS VARCHAR) AS OCCP
  FROM orders)"""


def _votes_sql() -> str:
    aliases = {**V.NAME_ALIASES, **VOTE_ALIASES}
    s = "lower(upper(p_name) || '  Jr, ' || p_type || ' (write-in)')"
    for cut in V.NAME_CUTS:
        s = f"split_part({s}, {S.q(cut)}, 1)"
    s = f"replace(trim({s}), '  ', ' ')"
    whens = " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in aliases.items())
    cand = f"coalesce(CASE {s} {whens} END, {s})"
    pw = " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in V.PARTIES.items())
    return f"""cr AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS fips, {cand} AS cand,
         CAST(l_quantity AS BIGINT) AS votes
  FROM lineitem JOIN part ON l_partkey = p_partkey),
crp AS (SELECT *, coalesce(CASE cand {pw} END, 'oth') AS party FROM cr)"""


def _spatial_sql() -> str:
    import math
    rs = np.random.default_rng(5)
    z = rs.normal(size=(3, SPATIAL_D))
    u = rs.chisquare(3, size=SPATIAL_D)
    w = z / np.sqrt(u / 3.0) * math.sqrt(3.0) / 560.0
    sc = repr(math.sqrt(0.18 / SPATIAL_D))
    cols = []
    for j in range(SPATIAL_D):
        ang = f"(x * {float(w[0, j])!r} + y * {float(w[1, j])!r} + z * {float(w[2, j])!r})"
        cols.append(f"round({sc} * sin({ang}), 6) AS m{j}")
    for j in range(SPATIAL_D):
        ang = f"(x * {float(w[0, j])!r} + y * {float(w[1, j])!r} + z * {float(w[2, j])!r})"
        cols.append(f"round({sc} * cos({ang}), 6) AS m{SPATIAL_D + j}")
    return "WITH " + CENTROID_SQL + """,
xyz AS (SELECT region, 6371.0 * sin(radians(lat)) * cos(radians(lon)) AS x,
               6371.0 * sin(radians(lat)) * sin(radians(lon)) AS y,
               6371.0 * cos(radians(lat)) AS z FROM cen)
SELECT region, """ + ", ".join(cols) + " FROM xyz"


CENTROID_SQL = """rect AS (
  SELECT n_name AS region, c_acctbal / 1000 AS x0, CAST(c_nationkey AS DOUBLE) AS y0,
         abs(c_acctbal) / 5000 + 0.1 AS w, 0.5 AS h
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
cen AS (SELECT region, sum(w * h * (x0 + w / 2)) / sum(w * h) AS lon,
               sum(w * h * (y0 + h / 2)) / sum(w * h) AS lat, sum(w * h) AS area
        FROM rect GROUP BY region)"""


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the linear embedding of every nation at sf0.001."""
    return q_linear_embedding(spark, SF_SMOKE)
