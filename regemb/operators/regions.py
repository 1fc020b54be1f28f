"""Region assignment and lookup joins.

Lookups (place -> region, state -> postal code, region -> super-region) are
joined many to one by :mod:`regemb.operators.lookup`: keys are normalised,
then proved unique in the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regemb.functions.geo import state_code
from regemb.operators.lookup import code, lookup_join, text
from regemb.operators.setops import difference


def assign_region(df: DataFrame, lookup: DataFrame, on: list[str],
                  region_col: str = "region") -> DataFrame:
    """Left join a place-code lookup; unmapped rows keep a null region.

    Codes are compared as numbers where both are numbers, else as text.
    """
    values = [c for c in lookup.columns if c not in on]
    return lookup_join(df, lookup, [(code(c), code(c)) for c in on], values,
                       what="the place lookup")


def assign_state(df: DataFrame, state_to_stab: DataFrame, st: str = "ST",
                 out: str = "region") -> DataFrame:
    """State code (int or zero-padded text) -> postal code.

    ``state_to_stab`` has ``state`` (int) and ``stab``; both sides are keyed
    by the two-digit zero-padded code.
    """
    return lookup_join(df, state_to_stab, [(state_code(st), state_code("state"))],
                       {"stab": out}, what="the state lookup")


def assign_puma_region(df: DataFrame, state_to_stab: DataFrame, st: str = "ST",
                       puma: str = "PUMA", out: str = "region") -> DataFrame:
    """Region ``<stab>_<puma>`` (null when the state is unknown)."""
    with_stab = assign_state(df, state_to_stab, st, "_stab")
    return (with_stab.withColumn(
        out, F.when(F.col("_stab").isNotNull(),
                    F.concat_ws("_", F.col("_stab"), F.col(puma).cast("string"))))
        .drop("_stab"))


def unmapped_report(df: DataFrame, keys: list[str], region_col: str = "region") -> DataFrame:
    """J6 + K2: places whose rows got no region, most common first."""
    return (df.where(F.col(region_col).isNull())
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), *keys))


def mapped_only(df: DataFrame, region_col: str = "region") -> DataFrame:
    """The rows that go into region partitions."""
    return df.where(F.col(region_col).isNotNull())


def strict_map(df: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """The mapped value of every row; a key without a mapping raises in the plan."""
    return lookup_join(df, mapping, [(text(key), text(key))], [value], how="strict",
                       what=f"the mapping of {key}")


def coverage(left: DataFrame, right: DataFrame, key: str) -> dict[str, DataFrame]:
    """Keys only on the left, keys only on the right, null-key rows."""
    lk, rk = left.select(key), right.select(key)
    return {
        "left_only": difference(lk, rk),
        "right_only": difference(rk, lk),
        "left_null": left.where(F.col(key).isNull()),
    }
