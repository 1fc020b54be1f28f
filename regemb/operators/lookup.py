"""Many-to-one joins with proof.

A lookup gives each key one row.  Its keys are normalised first and counted
after that, so ``("01", "00100")`` and ``("1", "100")`` are the same key; a key
that comes twice raises when the plan runs, and can never multiply rows.  With
``strict`` a row whose key the lookup lacks raises too.

Lookups are dimension tables.  One small job measures the bytes of the lookup's
columns: up to :data:`BROADCAST_MAX_BYTES` it is broadcast, beyond that the join
shuffles both sides (and AQE splits skewed keys).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_BYTES = 64 << 20
ROW_BYTES = 64           # what a row costs besides its text


def code(c: str | Column) -> Column:
    """A place code as text, without the leading zeros that only some files write."""
    x = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(x.try_cast("long").cast("string"), x)


def text(c: str | Column) -> Column:
    """A key that is compared as it is."""
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def is_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether the values of ``df`` take at most ``max_bytes``."""
    size = F.lit(ROW_BYTES)
    for c in df.columns:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= max_bytes


def unique_lookup(lookup: DataFrame, keys: Sequence[Column], values: Sequence[str],
                  what: str = "lookup") -> DataFrame:
    """``__k0.., values``: one row per normalised key; a repeated key raises in the plan.

    Rows with a null key match nothing and are left out.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    named = lookup.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)],
                          F.struct(*[F.col(v) for v in values]).alias("__v"))
    for n in names:
        named = named.where(F.col(n).isNotNull())
    grouped = named.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"),
                                        F.first("__v").alias("__v"))
    checked = F.when(F.col("__n") == 1, F.col("__v")).otherwise(F.raise_error(F.concat(
        F.lit(f"{what} repeats the key "), F.concat_ws(", ", *names))))
    return grouped.select(*names, checked.alias("__v")).select(
        *names, *[F.col(f"__v.{v}").alias(v) for v in values])


def lookup_join(df: DataFrame, lookup: DataFrame, on: Sequence[tuple[Column, Column]],
                values: Sequence[str] | dict[str, str], how: str = "left",
                what: str = "lookup") -> DataFrame:
    """``df`` with the lookup's ``values`` (or ``{column: new name}``) joined many to one.

    ``on`` pairs the normalised key of a row with that of the lookup.
    ``how``: ``left`` leaves unmatched rows null, ``inner`` drops them,
    ``strict`` raises in the plan.
    """
    out = dict(values) if isinstance(values, dict) else {v: v for v in values}
    lk = unique_lookup(lookup, [k for _, k in on], list(out), what)
    names = [f"__k{i}" for i in range(len(on))]
    lk = lk.select(*names, *[F.col(v).alias(f"__v_{n}") for v, n in out.items()],
                   F.lit(True).alias("__found"))
    if is_small(lookup.select(*[k.alias(n) for (_, k), n in zip(on, names, strict=True)], *out)):
        lk = F.broadcast(lk)
    keyed = df.withColumns({f"__d{i}": k for i, (k, _) in enumerate(on)})
    cond = F.lit(True)
    for i in range(len(on)):
        cond = cond & (F.col(f"__d{i}") == F.col(f"__k{i}"))
    joined = keyed.join(lk, cond, "inner" if how == "inner" else "left")
    found = {n: F.col(f"__v_{n}") for n in out.values()}
    if how == "strict":
        key = F.concat_ws(", ", *[F.coalesce(F.col(f"__d{i}"), F.lit("null"))
                                  for i in range(len(on))])
        missing = F.raise_error(F.concat(F.lit(f"{what} has no row for "), key))
        found = {n: F.when(F.col("__found"), c).otherwise(missing) for n, c in found.items()}
    kept = [c for c in df.columns if c not in found]
    return joined.select(*kept, *[c.alias(n) for n, c in found.items()])
