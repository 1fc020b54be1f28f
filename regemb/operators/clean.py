"""Schema checks, cleaning filters, adjustments and the household join.

P1 schema conformance, P2 geography-era filter, P3 eligible-voter filter,
P4 drops, P5 renames, P6/P7 inflation adjustments, J1 person x housing.
All are narrow transformations except J1 (a shuffle join on the household
key, which AQE may turn into a broadcast when the housing side is small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.spec import MicrodataSpec


class SchemaError(ValueError):
    pass


def check_schema(df: DataFrame, spec: MicrodataSpec) -> None:
    """Unknown or missing columns raise, naming them.

    Adjustment factor columns (and their ``_orig`` forms) are exempt from
    the unknown-column test.
    """
    cols = set(df.columns)
    expected = spec.expected_columns()
    extra = cols - expected - spec.adjust_columns()
    if extra:
        raise SchemaError(f"not in the spec {spec.name}: {', '.join(sorted(extra))}")
    missing = expected - cols
    if missing:
        raise SchemaError(f"the spec {spec.name} asks for {', '.join(sorted(missing))}")


def as_int(c: str | Column) -> Column:
    """Codes may arrive as text; compare them by their numeric meaning."""
    col = F.col(c) if isinstance(c, str) else c
    return col.try_cast("int")


def era_filter(df: DataFrame, year: str) -> DataFrame:
    """Keep rows coded in the wanted era, copy its code to ``PUMA``.

    ``PUMA<yy> = -9`` marks a row from the other era; null is kept (as the
    pandas comparison does).
    """
    src = f"PUMA{year}"
    keep = ~as_int(src).eqNullSafe(F.lit(-9))
    out = df.where(keep).withColumn("PUMA", F.col(src))
    return out.drop(*[c for c in ("PUMA00", "PUMA10") if c in out.columns])


def voters_only(df: DataFrame, age: str = "AGEP", cit: str = "CIT") -> DataFrame:
    """Adults who are citizens: ``AGEP >= 18 AND NOT (CIT <=> 5)``.

    A null citizenship code passes (not known to be a non-citizen); a code
    that is not a number is not 5 either.
    """
    return df.where((F.col(age).cast("double") >= 18) & ~as_int(cit).eqNullSafe(F.lit(5)))


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop columns that must exist."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise SchemaError(f"cannot drop missing columns {missing}")
    return df.drop(*cols)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P5: rename mapped columns, pass others through."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def adjust(df: DataFrame, factor: str, cols: list[str],
           enabled: bool | None = None) -> DataFrame:
    """Multiply ``cols`` by ``factor / 1e6`` and rename the factor.

    ``enabled=None`` detects: the factor column present means not yet
    adjusted; ``<factor>_orig`` present means already done; neither raises.
    An empty column list never adjusts.
    """
    if not cols:
        return df
    if enabled is None:
        if factor in df.columns:
            enabled = True
        elif f"{factor}_orig" in df.columns:
            enabled = False
        else:
            raise SchemaError(f"neither {factor} nor {factor}_orig is there: say with enabled= "
                              "whether the amounts still need the factor")
    if not enabled:
        return df
    f = F.col(factor).cast("double") / F.lit(1e6)
    return (df.withColumns({c: F.col(c).cast("double") * f for c in cols})
              .withColumnRenamed(factor, f"{factor}_orig"))


HOUSING_DROP = ("RT", "ST", "PUMA", "ADJINC_orig")


def join_housing(persons: DataFrame, housing: DataFrame, key: str = "SERIALNO",
                 drop: tuple[str, ...] | None = None) -> DataFrame:
    """Inner join of persons to their household on ``key``.

    Columns in ``drop`` (the census default: record type, place codes and the
    already-used factor) leave the housing side first; any other shared
    non-key column is an error.  Unmatched persons vanish.

    Both sides are fact tables keyed by household, so the join is a
    sort-merge join on the key (hinted: the planner's file-size estimate can
    otherwise pick the *person* side as a broadcast build when its pruned
    columns look small).  AQE still splits skewed keys.
    """
    drop = HOUSING_DROP if drop is None else drop
    hcols = [c for c in housing.columns if c not in set(drop) or c == key]
    shared = ({c.lower() for c in persons.columns} & {c.lower() for c in hcols}) - {key.lower()}
    if shared:
        raise SchemaError(f"person and housing tables share columns {sorted(shared)}")
    return persons.join(housing.select(*hcols).hint("merge"), key, "inner")


def clean(df: DataFrame, spec: MicrodataSpec, voters: bool = False,
          adjust_flags: dict[str, bool | None] | None = None) -> DataFrame:
    """The read-side cleaning chain in its required order.

    era filter -> voter filter -> drops -> renames -> adjustments.
    (Filtering before the adjustments and joins lets Catalyst push them
    down to the scan.)
    """
    if spec.era_subset:
        df = era_filter(df, spec.geo_year)
    if voters:
        df = voters_only(df)
    if spec.drops:
        df = drop_columns(df, list(spec.drops))
    if spec.renames:
        df = rename_columns(df, spec.renames)
    adjust_flags = adjust_flags or {}
    for factor, cols in spec.adjust.items():
        present = [c for c in cols if c in df.columns]
        df = adjust(df, factor, present, adjust_flags.get(factor))
    return df
