"""Dataset statistics (A1-A5) and the weighted reservoir sample (K1).

The stats bundle is four small tables rather than one driver-side dict:

- ``totals``        one row: ``n_total``, ``wt_total``
- ``reals``         ``(feature, cnt, mean, std)`` -- unweighted, population std
- ``value_counts``  ``(feature, level, cnt)`` -- unweighted, nulls excluded
- ``sample``        up to ``n`` rows drawn with probability proportional to weight

Each is one aggregation over a column-pruned scan.  When the input is a
written Parquet table (the ``sort`` job writes one), the three scans read
disjoint column sets, so together they cost about one full read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.session import stored
from regemb.spec import MicrodataSpec

NAN_LEVEL = "nan"


def totals(df: DataFrame, weight: str) -> DataFrame:
    """A1: row count and weight total."""
    return df.agg(F.count(F.lit(1)).alias("n_total"),
                  F.sum(F.col(weight)).alias("wt_total"))


def real_moments(df: DataFrame, reals: list[str], by: list[str] | None = None) -> DataFrame:
    """A2: per real feature the non-null count, mean and population std.

    One global aggregate (partial per task, merged once), then unpivoted to
    ``(feature, cnt, mean, std)``.  ``stddev_pop`` is Spark's central-moment
    aggregate, numerically stable without extended precision.
    """
    if not reals:
        return df.sparkSession.createDataFrame(
            [], "feature string, cnt bigint, mean double, std double")
    aggs = []
    for i, c in enumerate(reals):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"),
                 F.stddev_pop(x).alias(f"s{i}")]
    by = by or []
    wide = df.groupBy(*by).agg(*aggs)
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("cnt"),
                 F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
        for i, c in enumerate(reals)])
    return wide.select(*by, F.inline(entries))


def level_entries(columns: list[str]) -> Column:
    """``array<struct<feature, level>>`` of the given discrete columns."""
    return F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level"))
        for c in columns])


def value_counts(df: DataFrame, discrete: list[str]) -> DataFrame:
    """A4: ``(feature, level, cnt)`` over every discrete column, nulls excluded.

    The unpivot (``inline``) runs inside the scan stage and the count is
    combined map-side, so the shuffle carries at most
    tasks x features x levels rows whatever the table size or skew.
    """
    if not discrete:
        return df.sparkSession.createDataFrame(
            [], "feature string, level string, cnt bigint")
    return (df.select(F.inline(level_entries(discrete)))
              .where(F.col("level").isNotNull())
              .groupBy("feature", "level")
              .agg(F.count(F.lit(1)).alias("cnt")))


def needs_nan(vc: DataFrame, n_total: int) -> DataFrame:
    """A5: a feature needs a ``nan`` level iff its counts sum below n_total.

    Features that never take a value at all (no rows in ``vc``) are not
    listed; callers treat them as needing ``nan`` when n_total > 0.
    """
    return (vc.groupBy("feature")
              .agg((F.sum("cnt") < F.lit(n_total)).alias("needs_nan")))


# ---------------------------------------------------------------------------
# K1: weighted sampling without replacement


def hash_uniform(key: Column) -> Column:
    """A uniform (0, 1] number from a hash of ``key``; reproducible anywhere.

    ``md5`` of the key's text, first 60 bits, divided by 2^60 (so that ties stay
    rare at 10^12 rows); zero is moved to 2^-61 so the logarithm below stays
    finite.
    """
    h = F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long").cast("double")
    u = h / F.lit(2.0 ** 60)
    return F.when(u <= 0, F.lit(2.0 ** -61)).otherwise(u)


def sample_key(weight: Column, u: Column) -> Column:
    """Efraimidis-Spirakis key in log form: keep the smallest ``-ln(u)/w``.

    Same order as keeping the largest ``u ** (1/w)``.  Rows with a missing or
    non-positive weight get +inf and are only taken when nothing else is left.
    """
    w = weight.cast("double")
    return F.when(w > 0, -F.log(u) / w).otherwise(F.lit(float("inf")))


def _row_key(df: DataFrame, spec: MicrodataSpec) -> list[str] | None:
    """Columns that tell persons apart: the household key and the member's number."""
    if not spec.key:
        return None
    member = [c for c in ("SPORDER", "sporder") if c in df.columns and c != spec.key]
    return [spec.key, *member[:1]]


def weighted_sample(df: DataFrame, weight: str, n: int = 5000,
                    key: str | list[str] | None = None, seed: int = 0,
                    total_weight: float | None = None, oversample: float = 3.0) -> DataFrame:
    """K1: ``n`` rows drawn without replacement with probability ~ weight.

    The draw keeps the ``n`` smallest keys ``-ln(u)/w``.  A plain
    ``orderBy(key).limit(n)`` would send every task's local top ``n`` to one
    final task (tasks x n rows on a large cluster), so the keys are first cut
    at a threshold ``t``: a row passes with probability ``1 - exp(-w t)``, so
    ``t = oversample * n / sum(w)`` keeps about ``oversample * n`` rows.  If
    fewer than ``n`` pass, ``t`` grows and the count is repeated; the ``n``
    smallest keys are always below a threshold that passes ``n`` rows, so the
    result is exactly the unfiltered one.  ``key`` must name a row (several
    columns if need be): rows of one key are drawn together.  Without a key
    a row is named by its contents and its number among equal rows, so the
    draw does not depend on the partitioning either; that costs two shuffles of
    the distinct rows, so the rows below the threshold (about ``oversample * n``,
    at most some ``8 * n``) are written once instead of being numbered again.
    """
    keys = [key] if isinstance(key, str) else list(key or [])
    columns = df.columns
    if total_weight is None:
        total_weight = df.agg(F.sum(F.when(F.col(weight) > 0, F.col(weight)))).first()[0]
    if not keys:
        df, keys = _numbered_copies(df, seed), ["_content", "_copy"]
    joined = F.col(keys[0]) if len(keys) == 1 else F.concat_ws(
        "\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    u = hash_uniform(joined)
    order = [F.col("_sample_key"), *map(F.col, keys)]
    keyed = df.withColumn("_sample_key", sample_key(F.col(weight), u))
    cut = keyed
    if total_weight and total_weight > 0:
        t = oversample * n / float(total_weight)
        for _ in range(6):
            below = keyed.where(F.col("_sample_key") <= t)
            if not key:
                below = stored(below, "sample")
            if below.limit(n).count() >= n:
                cut = below
                break
            t *= 8.0
    return cut.orderBy(*order).limit(n).select(*columns)


COPY_RUN = 10_000


def _numbered_copies(df: DataFrame, seed: int) -> DataFrame:
    """Rows named by a digest of their contents (``_content``) and a number among equals.

    Equal rows are counted (combined before the shuffle, so a row that a third
    of the table repeats is no hot group) and laid out again by number.  The
    counts of a long table can be a few small rows, which adaptive execution
    puts into one task; so they are cut into runs of ``COPY_RUN`` numbers and
    dealt to a fixed number of tasks before they are laid out.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                spark.sparkContext.defaultParallelism)
    told = F.concat_ws("\x1f", F.lit(str(seed)), *[
        F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null"))
        for c in df.columns])
    first = F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(COPY_RUN).cast("long"))
    runs = (df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
              .select(*df.columns, "_n", F.explode(first).alias("_copy_from"))
              .repartition(parts, *df.columns, "_copy_from")
              .withColumn("_content", F.sha2(told, 256)))
    last = F.least(F.col("_n"), F.col("_copy_from") + (COPY_RUN - 1))
    return runs.select(*df.columns, "_content",
                       F.explode(F.sequence("_copy_from", last)).alias("_copy"))


# ---------------------------------------------------------------------------


@dataclass
class Stats:
    """The stats bundle.

    Counts of levels stay tables, however many levels there are; the driver
    only holds what grows with the *columns* of the spec: the totals, a mean
    and a deviation per real, and per discrete feature the number of its
    levels and values.  ``dictionary()`` is the stored table that gives every
    level its rank; encoders join it.
    """

    spec: MicrodataSpec
    totals: DataFrame
    reals: DataFrame
    value_counts: DataFrame
    sample: DataFrame | None = None
    region_type: str | None = None
    _tot: dict | None = field(default=None, repr=False)
    _real_params: dict | None = field(default=None, repr=False)
    _features: dict | None = field(default=None, repr=False)
    _dictionary: DataFrame | None = field(default=None, repr=False)

    def materialize(self) -> "Stats":
        if self._tot is None:
            row = self.totals.first()
            self._tot = {"n_total": int(row["n_total"]), "wt_total": row["wt_total"]}
        if self._real_params is None:
            self._real_params = {r["feature"]: (r["mean"], r["std"])
                                 for r in self.reals.collect()}
        if self._features is None:
            self._features = {r["feature"]: (int(r["levels"]), int(r["n"]), bool(r["has_nan"]),
                                             int(r["bytes"]))
                              for r in feature_counts(self.value_counts).collect()}
        return self

    def n_total(self) -> int:
        return self.materialize()._tot["n_total"]

    def wt_total(self):
        return self.materialize()._tot["wt_total"]

    def real_params(self) -> dict[str, tuple[float | None, float | None]]:
        """``{feature: (mean, std)}``; one row per real feature of the spec."""
        return self.materialize()._real_params

    def needs_nan(self) -> dict[str, bool]:
        """``{feature: bool}`` for every discrete feature (and flag) of the spec."""
        counts, n = self.materialize()._features, self.n_total()
        return {f: counts.get(f, NO_LEVELS)[1] < n for f in self.spec.discrete_all}

    def needs_nan_df(self) -> DataFrame:
        return needs_nan(self.value_counts, self.n_total())

    def sizes(self) -> dict[str, int]:
        """Encoded columns of every discrete feature: its levels, and ``nan`` where needed."""
        counts, nn = self.materialize()._features, self.needs_nan()
        return {f: counts.get(f, NO_LEVELS)[0]
                + (nn[f] and not counts.get(f, NO_LEVELS)[2]) for f in nn}

    def level_bytes(self, features: list[str]) -> int:
        """Bytes that the dictionary of these features takes, about: texts and 64 a row."""
        counts, sizes = self.materialize()._features, self.sizes()
        return sum(counts.get(f, NO_LEVELS)[3] + 64 * sizes[f] for f in features)

    def dictionary(self) -> DataFrame:
        """``feature, level, rank``: levels by text, ``nan`` last, stored once.

        The rank comes from a sort by ranges: rows are numbered inside each
        range and the ranges' sizes are summed up, so no task holds all
        levels of a feature.
        """
        if self._dictionary is None:
            self._dictionary = _ranked_levels(self)
        return self._dictionary

    def levels(self) -> dict[str, list[str]]:
        """``{feature: sorted levels}`` as a listing on the driver (reports, ordered coding)."""
        out: dict[str, list[str]] = {}
        for r in self.value_counts.select("feature", "level").collect():
            out.setdefault(r["feature"], []).append(r["level"])
        return {f: sorted(v) for f, v in out.items()}


def feature_counts(vc: DataFrame) -> DataFrame:
    """``feature, levels, n, has_nan``: one row per discrete feature with values."""
    return vc.groupBy("feature").agg(
        F.count(F.lit(1)).alias("levels"), F.sum("cnt").alias("n"),
        F.max(F.col("level") == NAN_LEVEL).alias("has_nan"),
        F.sum(F.octet_length("level").cast("long")).alias("bytes"))


#: Levels, values, whether one is spelled ``nan``, bytes of a feature without values.
NO_LEVELS = (0, 0, False, 0)


def _ranked_levels(stats: Stats) -> DataFrame:
    spark = stats.totals.sparkSession
    features = list(stats.spec.discrete_all)
    schema = "feature string, level string, rank long"
    if not features:
        return spark.createDataFrame([], schema)
    nn = stats.needs_nan()
    nans = spark.createDataFrame([(f, NAN_LEVEL) for f in features if nn[f]],
                                 "feature string, level string")
    level_of_nan = F.when(F.col("feature").isin([f for f in features if nn[f]]),
                          F.col("level") == NAN_LEVEL).otherwise(F.lit(False))
    rows = (stats.value_counts.select("feature", "level")
            .where(~level_of_nan & F.col("feature").isin(features)).unionByName(nans)
            .select(F.array_position(F.array(*map(F.lit, features)), F.col("feature")).alias("f"),
                    level_of_nan.alias("last"), "feature", "level")
            .repartitionByRange("f", "last", "level").sortWithinPartitions("f", "last", "level")
            # task number in the high bits, row number inside the task in the low 33
            .withColumn("at", F.monotonically_increasing_id()))
    placed = stored(rows, "levels")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # one row per range, as many as the sort has tasks
    held = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    before = list(itertools.accumulate([held.get(i, 0) for i in range(max(held, default=0) + 1)],
                                       initial=0))
    sizes = stats.sizes()
    first = list(itertools.accumulate([sizes[f] for f in features], initial=0))

    def listed(values: list[int], at: Column) -> Column:
        numbers = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
        return F.get(numbers, at.cast("int"))
    return placed.select("feature", "level", (listed(before, part) + row - listed(first, F.col("f") - 1))
                         .alias("rank"))


TOTAL_KEY = "__n__"


def compute_stats(df: DataFrame, spec: MicrodataSpec, sample_size: int = 5000,
                  sample_key_col: str | list[str] | None = None, seed: int = 0,
                  region_type: str | None = None) -> Stats:
    """A1 + A2 + A4 in one scan (+ K1 when ``sample_size``).

    Every row is unpivoted into ``(feature, level, x)`` entries -- one total
    entry carrying the weight, one per real carrying its value, one per
    discrete column carrying its level -- and a single
    ``groupBy(feature, level)`` computes row counts, non-null counts, weight
    sums, means and population stds.  The aggregate is stored once.  Totals
    and moments (a row per real) are read back to the driver; the counts of
    levels stay a table.
    """
    spark = df.sparkSession
    reals = list(spec.real)
    disc = list(spec.discrete_all)
    nul = F.lit(None).cast("string")
    ent = [F.struct(F.lit(TOTAL_KEY).alias("feature"), nul.alias("level"),
                    F.col(spec.weight).cast("double").alias("x"))]
    ent += [F.struct(F.lit(r).alias("feature"), nul.alias("level"),
                     F.col(r).cast("double").alias("x")) for r in reals]
    ent += [F.struct(F.lit(d).alias("feature"), F.col(d).cast("string").alias("level"),
                     F.lit(None).cast("double").alias("x")) for d in disc]
    agg = stored(df.select(F.inline(F.array(*ent)))
                    .where(F.col("level").isNotNull() | F.col("x").isNotNull()
                           | F.col("feature").isin([TOTAL_KEY] + reals))
                    .groupBy("feature", "level")
                    .agg(F.count(F.lit(1)).alias("rows"), F.count("x").alias("cnt"),
                         F.sum("x").alias("sx"), F.avg("x").alias("mean"),
                         F.stddev_pop("x").alias("std")), "stats")
    value_counts = agg.where(F.col("level").isNotNull()).select(
        "feature", "level", F.col("rows").alias("cnt"))
    # one row per column of the spec: the totals and moments, or a feature's levels
    rows = (agg.groupBy("feature", F.col("level").isNull().alias("plain"))
               .agg(F.sum("rows").alias("rows"), F.sum("cnt").alias("cnt"), F.sum("sx").alias("sx"),
                    F.max("mean").alias("mean"), F.max("std").alias("std"),
                    F.count("level").alias("levels"),
                    F.sum(F.octet_length("level").cast("long")).alias("bytes"),
                    F.max(F.col("level") == NAN_LEVEL).alias("has_nan")).collect())
    plain = {r["feature"]: r for r in rows if r["plain"]}
    tot_row = plain.get(TOTAL_KEY)
    n_total = int(tot_row["rows"]) if tot_row else 0
    wt_total = tot_row["sx"] if tot_row else None
    real_rows = []
    for r in reals:
        x = plain.get(r)
        real_rows.append((r, int(x["cnt"]) if x else 0, x["mean"] if x else None,
                          x["std"] if x else None))
    tot = spark.createDataFrame([(n_total, wt_total)], "n_total long, wt_total double")
    real_df = spark.createDataFrame(real_rows, "feature string, cnt long, mean double, std double")
    samp = None
    if sample_size:
        samp = weighted_sample(df, spec.weight, sample_size,
                               key=sample_key_col or _row_key(df, spec), seed=seed,
                               # any positive total keeps the draw exact (the
                               # threshold only widens when it is too tight)
                               total_weight=wt_total)
    st = Stats(spec, tot, real_df, value_counts, samp, region_type)
    st._tot = {"n_total": n_total, "wt_total": wt_total}
    st._real_params = {r: (m, s_) for r, _, m, s_ in real_rows}
    st._features = {r["feature"]: (int(r["levels"]), int(r["rows"]), bool(r["has_nan"]),
                                   int(r["bytes"]))
                    for r in rows if not r["plain"]}
    return st


def merge_moments(batch_reals: DataFrame) -> DataFrame:
    """A3: recombine per-batch ``(feature, cnt, mean, std)`` tables.

    Each batch contributes its count-weighted first and second moments, so a
    newly loaded batch only needs its own scan.
    """
    m2 = F.col("std") * F.col("std") + F.col("mean") * F.col("mean")
    g = (batch_reals.where(F.col("cnt") > 0)
         .groupBy("feature")
         .agg(F.sum("cnt").alias("cnt"),
              F.sum(F.col("cnt") * F.col("mean")).alias("s1"),
              F.sum(F.col("cnt") * m2).alias("s2")))
    mean = F.col("s1") / F.col("cnt")
    var = F.greatest(F.col("s2") / F.col("cnt") - mean * mean, F.lit(0.0))
    return g.select("feature", "cnt", mean.alias("mean"), F.sqrt(var).alias("std"))
