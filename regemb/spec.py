"""Column roles of a microdata table.

A ``MicrodataSpec`` says which column is the survey weight, which columns are
real-valued or discrete features, which are allocation flags, which columns
are scaled by which adjustment factor, and which columns are dropped or
renamed on read.  The census file versions are instances (``regemb.census``);
so is the stand-in built from the test tables (``regemb.plans.standin``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class MicrodataSpec:
    name: str
    weight: str
    real: tuple[str, ...] = ()
    discrete: tuple[str, ...] = ()
    alloc: tuple[str, ...] = ()
    meta: tuple[str, ...] = ()
    extra_weights: tuple[str, ...] = ()
    # factor column -> columns multiplied by factor / 1e6
    adjust: dict[str, tuple[str, ...]] = field(default_factory=dict)
    drops: tuple[str, ...] = ()
    renames: dict[str, str] = field(default_factory=dict)
    geo_year: str = "10"
    # era-mixed files carry PUMA00/PUMA10 with -9 for "other era"
    era_subset: bool = False
    key: str | None = None
    # columns with extra missing-value tokens on read
    na_columns: tuple[str, ...] = ()
    # of a spec made by with_housing: its person part and its housing part
    alone: "MicrodataSpec | None" = None
    partner: "MicrodataSpec | None" = None

    @property
    def discrete_all(self) -> tuple[str, ...]:
        """Discrete features followed by allocation flags (stats cover both)."""
        return tuple(self.discrete) + tuple(self.alloc)

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.real) + self.discrete_all

    @property
    def weights(self) -> tuple[str, ...]:
        return (self.weight,) + tuple(self.extra_weights)

    def expected_columns(self) -> set[str]:
        """Columns a conforming table must hold (after drops and renames)."""
        return (set(self.meta) | set(self.weights) | set(self.real)
                | set(self.discrete) | set(self.alloc))

    def adjust_columns(self) -> set[str]:
        cols = set()
        for f in self.adjust:
            cols |= {f, f + "_orig"}
        return cols

    def with_housing(self, housing: "MicrodataSpec") -> "MicrodataSpec":
        """Person spec extended by a housing spec (lists concatenated)."""
        adj = dict(self.adjust)
        for k, v in housing.adjust.items():
            adj[k] = tuple(adj.get(k, ())) + tuple(c for c in v if c not in adj.get(k, ()))
        return replace(
            self,
            name=f"{self.name}+{housing.name}",
            real=tuple(self.real) + tuple(housing.real),
            discrete=tuple(self.discrete) + tuple(housing.discrete),
            alloc=tuple(self.alloc) + tuple(housing.alloc),
            extra_weights=tuple(self.extra_weights) + (housing.weight,)
            + tuple(housing.extra_weights),
            adjust=adj,
            alone=self,
            partner=housing,
        )

    def restrict(self, keep: set[str]) -> "MicrodataSpec":
        """The same spec with features outside ``keep`` removed."""
        return replace(
            self,
            real=tuple(c for c in self.real if c in keep),
            discrete=tuple(c for c in self.discrete if c in keep),
            alloc=tuple(c for c in self.alloc if c in keep),
        )


def skip_features(spec: MicrodataSpec, only: list[str] | None = None,
                  skip: list[str] | None = None,
                  skip_alloc_flags: bool = True) -> set[str]:
    """Which features a featurizer leaves out.

    ``only`` keeps exactly those features and must not overlap ``skip``;
    without ``only``, allocation flags are skipped by default.
    """
    skip_set = set(skip or ())
    if only is not None:
        only_set = set(only)
        if not only_set.isdisjoint(skip_set):
            raise ValueError(f"only and skip overlap: {sorted(only_set & skip_set)}")
        return set(spec.features) - only_set
    if skip_alloc_flags:
        skip_set |= set(spec.alloc)
    return skip_set
