"""regemb: weighted microdata -> per-region distribution embeddings, on Spark.

Layout
------
- ``spec``        column roles of a microdata table (weight, reals, discrete ...)
- ``census``      the census file versions as specs
- ``sources``     CSV / Parquet readers, lookup tables, sinks
- ``operators``   cleaning, region assignment, stats, encoding, embeddings,
                  roll-ups, random features, connected components, models
- ``functions``   column-level recodes and small scalar helpers
- ``plans``       the end-to-end jobs (sort, featurize, merge, export)
- ``streaming``   incremental (micro-batch) embedding maintenance

The user-level jobs are importable from the package root::

    from regemb import sort_by_region, featurize, merge_features, export, weight_counts
"""

from regemb.spec import MicrodataSpec, skip_features

__version__ = "0.1.0"

_LAZY = {
    "sort_by_region": ("regemb.plans.sort", "sort_by_region"),
    "featurize": ("regemb.plans.featurize", "featurize"),
    "RFFConfig": ("regemb.plans.featurize", "RFFConfig"),
    "ExtrasConfig": ("regemb.plans.featurize", "ExtrasConfig"),
    "merge_features": ("regemb.plans.merge", "merge_features"),
    "export": ("regemb.plans.merge", "export"),
    "weight_counts": ("regemb.plans.merge", "weight_counts"),
    "compute_stats": ("regemb.operators.stats", "compute_stats"),
    "linear_embedding": ("regemb.operators.embed", "linear_embedding"),
    "rff_embedding": ("regemb.operators.rff", "rff_embedding"),
    "census_profile": ("regemb.functions.census_profile", "census_profile"),
    "additive_extras": ("regemb.plans.featurize", "additive_extras"),
    "get_spark": ("regemb.session", "get_spark"),
    "drop_scratch": ("regemb.session", "drop_scratch"),
    "census_version": ("regemb.census", "version"),
}


def __getattr__(name):
    # imported on first use, so `import regemb` stays light on workers
    if name in _LAZY:
        import importlib
        mod, attr = _LAZY[name]
        return getattr(importlib.import_module(mod), attr)
    raise AttributeError(name)


__all__ = ["MicrodataSpec", "skip_features", *_LAZY]
