"""``merge-features``, ``export`` and ``weight-counts`` jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from regemb.operators import rollup
from regemb.operators.embed import Embedding
from regemb.sources import sinks


def merge_features(embs: dict[str, Embedding | list[Embedding]], how: str = "state",
                   mapping: DataFrame | None = None) -> dict[str, Embedding | list[Embedding]]:
    """Roll every embedding (and every extra) up to states or
    super-regions; conditional features keep their per-level weights."""
    if how == "state":
        one = rollup.state_rollup
    elif how == "superregion":
        if mapping is None:
            raise ValueError("super-region roll-up needs the region -> merged_region table")
        def one(e):
            return rollup.superregion_rollup(e, mapping)
    else:
        raise ValueError(f"unknown roll-up {how!r}")
    return {k: ([one(x) for x in e] if isinstance(e, list) else one(e)) for k, e in embs.items()}


def export(emb: Embedding, names: list[str], path: str, rff: Embedding | None = None,
           rff_names: list[str] | None = None) -> None:
    """``<path>_linear.csv`` (and ``<path>_rff.csv``) wide tables."""
    sinks.export_wide(emb, names, f"{path}_linear.csv")
    if rff is not None:
        sinks.export_wide(rff, rff_names or [], f"{path}_rff.csv")


def weight_counts(emb: Embedding, path: str) -> DataFrame:
    """Region weights as CSV."""
    return sinks.write_region_weights(emb, path)
