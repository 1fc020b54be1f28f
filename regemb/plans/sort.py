"""The ``sort`` job: raw microdata -> region-partitioned Parquet + stats.

read (S1/S2) -> clean (P2-P7) -> household join (J1) -> schema check (P1)
-> region lookup (J3-J5) -> unmapped report (J6) -> partitioned write (S4)
and stats (A1-A5, K1) over *all* cleaned rows (unmapped rows count in the
stats but are not written to any region).

The cleaned and joined rows are stored once in the shared folder; the report,
the partitions, the stats and the sample all read that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from regemb.operators.clean import check_schema, clean, join_housing
from regemb.operators.regions import (assign_puma_region, assign_region, assign_state,
                                      mapped_only, unmapped_report)
from regemb.operators.stats import Stats, compute_stats
from regemb.session import stored
from regemb.sources.sinks import save_stats, write_partitioned
from regemb.spec import MicrodataSpec

REGION_TYPES = ("puma_county", "puma", "state")


@dataclass
class SortResult:
    stats: Stats
    unmapped: DataFrame
    data: DataFrame


def with_regions(df: DataFrame, region_type: str, lookup: DataFrame,
                 keys: list[str]) -> DataFrame:
    """The region column of the chosen kind.

    ``puma_county`` joins a place lookup on ``keys``; ``puma`` and ``state``
    take a ``(state, stab)`` table and use the columns ``ST`` and ``PUMA``.
    """
    if region_type == "puma_county":
        return assign_region(df, lookup, keys)
    if region_type == "puma":
        return assign_puma_region(df, lookup)
    if region_type == "state":
        return assign_state(df, lookup)
    raise ValueError(f"region_type {region_type!r} is none of {REGION_TYPES}")


def sort_by_region(raw: DataFrame, spec: MicrodataSpec, region_lookup: DataFrame,
                   lookup_keys: list[str], out_path: str | None = None,
                   stats_path: str | None = None, voters_only: bool = True,
                   adjust_flags: dict[str, bool | None] | None = None,
                   housing: DataFrame | None = None, housing_spec: MicrodataSpec | None = None,
                   housing_drop: tuple[str, ...] | None = None,
                   sample_size: int = 5000, region_type: str = "puma_county",
                   check: bool = True, mode: str = "errorifexists",
                   stats_only: bool = False) -> SortResult:
    """Run the whole job.  ``stats_only`` writes no partitions.

    A spec made by ``with_housing`` knows its two parts: persons and housing
    are then cleaned by their own part.  Without such a spec and without
    ``housing_spec`` the housing rows are joined as they come.
    """
    housing_spec = housing_spec or spec.partner
    person_spec = spec.alone or spec
    df = clean(raw, person_spec, voters=voters_only, adjust_flags=adjust_flags)
    full_spec = person_spec if housing is None else spec
    if housing is not None:
        if housing_spec is not None:
            housing = clean(housing, housing_spec, adjust_flags=adjust_flags)
            full_spec = person_spec.with_housing(housing_spec)
        df = join_housing(df, housing, key=spec.key or "SERIALNO", drop=housing_drop)
    if check:
        check_schema(df, full_spec)
    df = stored(with_regions(df, region_type, region_lookup, lookup_keys), "sorted")
    unmapped = unmapped_report(df, lookup_keys)
    if out_path and not stats_only:
        write_partitioned(mapped_only(df), out_path, mode=mode)
    stats = compute_stats(df, full_spec, sample_size=sample_size, region_type=region_type)
    if stats.sample is not None:
        stats.sample = stored(stats.sample, "sample")
    if stats_path:
        save_stats(stats, stats_path, mode=mode)
    return SortResult(stats, unmapped, df)
