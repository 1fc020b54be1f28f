"""Election results by region.

County results are ``(fips, candidate, votes)`` rows; candidate names are
normalised, assigned to a party, and votes summed per region and party into
a wide ``votes_<party>`` table.  All steps are built-in expressions and
aggregates; the county -> region lookup is a checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.operators.lookup import lookup_join, text

# ---------------------------------------------------------------------------
# FIXED VALUES: name separators, aliases and party assignments of the 2012
# county results, in natural order.
NAME_CUTS = ["/", ",", "(", " and", " for president"]
NAME_ALIASES = {
    "goode": "virgil goode",
    "obama": "barack obama",
    "johnson": "gary johnson",
    "romney": "mitt romney",
    "stein": "jill stein",
    "virgil h. goode": "virgil goode",
    "virgil h. goode jr.": "virgil goode",
    "gary e. johnson": "gary johnson",
    "write in": "write-in",
    "write-ins": "write-in",
    "hoefling": "tom hoefling",
    "obama barack": "barack obama",
    "stein jill": "jill stein",
    "romney mitt": "mitt romney",
    "johnson gary": "gary johnson",
    "jill stein write-in": "jill stein",
    "hoefling (write-in)": "tom hoefling",
    "tom hoeffling": "tom hoefling",
    "alexander": "stewart alexander",
    "ross c. &quot;rocky&quot;": 'ross c. "rocky"',
    "ross c. rocky": 'ross c. "rocky"',
    "ross c.": 'ross c. "rocky"',
    "rocky": 'ross c. "rocky"',
    "paul": "ron paul",
    "ron paul write-in": "ron paul",
    "write-in**": "write-in",
    "clymer": "james clymer",
    "roth": "cecil james roth",
    "prokopich": "barbara prokopich",
    "barbara a. prokopich": "barbara prokopich",
    "kevin m. thorne": "kevin thorne",
    "thorne": "kevin thorne",
}
PARTIES = {"barack obama": "D", "mitt romney": "R", "gary johnson": "L", "jill stein": "G"}
PARTY_ORDER = ["D", "R", "L", "G", "oth"]
OTHER_PARTY = "oth"
# ---------------------------------------------------------------------------


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def normalize_candidate(c: str | Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower-case, cut at the first of each separator, trim, fold double
    blanks, then apply the alias table."""
    s = F.lower(F.col(c) if isinstance(c, str) else c)
    for cut in NAME_CUTS:
        s = F.substring_index(s, cut, 1)
    s = F.replace(F.trim(s), F.lit("  "), F.lit(" "))
    aliases = NAME_ALIASES if aliases is None else aliases
    return F.coalesce(_lit_map(aliases)[s], s) if aliases else s


def party(cand: str | Column, parties: dict[str, str] | None = None) -> Column:
    """Party letter of a normalised name; everyone else is ``oth``."""
    parties = PARTIES if parties is None else parties
    x = F.col(cand) if isinstance(cand, str) else cand
    return F.coalesce(_lit_map(parties)[x], F.lit(OTHER_PARTY))


def votes_by(df: DataFrame, key: str, votes: str = "votes") -> DataFrame:
    """Total votes by candidate or party."""
    return df.groupBy(key).agg(F.sum(votes).alias("votes"))


def top_candidates(df: DataFrame, n: int = 50, key: str = "cand") -> DataFrame:
    """K3: the ``n`` candidates with most votes (a top-k report)."""
    return votes_by(df, key).orderBy(F.desc("votes"), key).limit(n)


def region_party_table(df: DataFrame, county_region: DataFrame, fips: str = "fips",
                       parties: list[str] | None = None) -> DataFrame:
    """J8 + A23: ``region, votes_<p>...`` with integer sums, 0 when absent.

    Counties missing from the lookup (overseas ballots) fall out (inner
    join).  The pivot values are given, so no extra pass finds them.
    """
    parties = parties or PARTY_ORDER
    j = lookup_join(df, county_region, [(text(fips), text(fips))], ["region"], how="inner",
                    what="the county lookup")
    wide = j.groupBy("region").pivot("party", parties).agg(F.sum("votes"))
    return wide.select("region", *[F.coalesce(F.col(p), F.lit(0)).cast("long")
                                   .alias(f"votes_{p}") for p in parties])


def precinct_rollup(precincts: DataFrame, state: str, fips: str, county: str,
                    cand: str = "candidate", votes: str = "votes") -> DataFrame:
    """Precinct rows summed per candidate and labelled as one county."""
    return (precincts.groupBy(cand).agg(F.sum(votes).alias(votes))
            .select(F.lit(fips).alias("fips"), F.lit(county).alias("county"), cand, votes,
                    F.lit(state).alias("state")))


def read_state_files(spark, pattern: str) -> DataFrame:
    """County result CSVs named ``<st>.csv``; state from the file name.

    Each file is read by its own header and the columns are matched by name,
    so files may order them differently.
    """
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(pattern)
                   .select("path").collect())      # one per state
    parts = [spark.read.option("header", True).csv(f)
             .select("fips", "county", "candidate", "votes") for f in files]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = df.withColumn("_file", F.input_file_name())
    return (df.withColumn("fips", F.col("fips").cast("string"))
              .withColumn("votes", F.col("votes").try_cast("long"))
              .withColumn("state", F.regexp_extract("_file", r"([a-z]{2})\.csv$", 1))
              .drop("_file"))
