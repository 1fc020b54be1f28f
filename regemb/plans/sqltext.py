"""ANSI/DuckDB text of the stand-in computations, for the oracle check.

These strings restate the operators declaratively over the raw test tables
so an independent engine can recompute them.  They are generated from the
same spec so both sides agree on feature order and names.
"""

from __future__ import annotations

from regemb.plans.standin import STANDIN, person_sql
from regemb.spec import MicrodataSpec


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def stats_ctes(spec: MicrodataSpec = STANDIN, source: str = "person") -> str:
    """``rstats(feature, cnt, mean, std)``, ``vc(feature, level, cnt)``,
    ``nn(feature, needs_nan)``, ``tot(n_total, wt_total)``."""
    reals = " UNION ALL ".join(
        f"SELECT {q(r)} AS feature, count({r}) AS cnt, avg({r}) AS mean, "
        f"stddev_pop({r}) AS std FROM {source}" for r in spec.real)
    vcs = " UNION ALL ".join(
        f"SELECT {q(d)} AS feature, CAST({d} AS VARCHAR) AS level FROM {source}"
        for d in spec.discrete_all)
    return f"""
tot AS (SELECT count(*) AS n_total, sum({spec.weight}) AS wt_total FROM {source}),
rstats AS ({reals}),
vc AS (SELECT feature, level, count(*) AS cnt FROM ({vcs}) u
       WHERE level IS NOT NULL GROUP BY feature, level),
nn AS (SELECT feature, sum(cnt) < (SELECT n_total FROM tot) AS needs_nan
       FROM vc GROUP BY feature)"""


def catalogue_cte(spec: MicrodataSpec = STANDIN, skip: set[str] | None = None) -> str:
    """``cat(pos, feature_name, feature_id, feature, level, keep)``."""
    skip = set(spec.alloc) if skip is None else skip
    reals = [r for r in spec.real if r not in skip]
    disc = [d for d in spec.discrete_all if d not in skip]
    real_rows = " UNION ALL ".join(
        f"SELECT {i} AS pos, {q(r)} AS feature_name, {q(r)} AS feature_id, "
        f"{q(r)} AS feature, CAST(NULL AS VARCHAR) AS level, TRUE AS keep"
        for i, r in enumerate(reals))
    if not disc:
        return f"cat AS ({real_rows})"
    inlist = ", ".join(q(d) for d in disc)
    ford = "CASE feature " + " ".join(f"WHEN {q(d)} THEN {i}" for i, d in enumerate(disc)) + " END"
    return f"""
lv AS (SELECT feature, level, 0 AS is_nan FROM vc WHERE feature IN ({inlist})
       UNION ALL SELECT feature, 'nan', 1 FROM nn WHERE needs_nan AND feature IN ({inlist})),
ranked AS (SELECT feature, level, {ford} AS ford,
             row_number() OVER (PARTITION BY feature ORDER BY is_nan, level) AS rk,
             count(*) OVER (PARTITION BY feature) AS n FROM lv),
offs AS (SELECT feature, coalesce(sum(n) OVER (ORDER BY ford ROWS BETWEEN UNBOUNDED PRECEDING
                                               AND 1 PRECEDING), 0) AS off
         FROM (SELECT DISTINCT feature, ford, n FROM ranked) f),
cat AS (SELECT CAST({len(reals)} + off + rk - 1 AS INTEGER) AS pos,
               feature || '_' || level AS feature_name, feature AS feature_id, feature, level,
               NOT (rk = 1 AND n > 1) AS keep
        FROM ranked JOIN offs USING (feature)
        {('UNION ALL ' + real_rows) if real_rows else ''})"""


def z_expr(r: str) -> str:
    return (f"coalesce(({r} - (SELECT mean FROM rstats WHERE feature = {q(r)})) / "
            f"nullif((SELECT std FROM rstats WHERE feature = {q(r)}), 0), 0.0)")


def level_expr(d: str) -> str:
    return (f"coalesce(CAST({d} AS VARCHAR), CASE WHEN (SELECT needs_nan FROM nn "
            f"WHERE feature = {q(d)}) THEN 'nan' END)")


def with_person(body_ctes: str, region_expr: str = "n.n_name") -> str:
    return "WITH " + person_sql(region_expr).strip() + ",\n" + body_ctes.strip().lstrip(",")


def linear_sql(spec: MicrodataSpec = STANDIN, subsets: list[str] | None = None,
               skip: set[str] | None = None, ordered: dict[str, list[str]] | None = None,
               pairs: list[tuple[str, str]] | None = None, reals_on: bool = True,
               disc_on: bool = True, weight_out: bool = False,
               only_features: list[str] | None = None,
               region_expr: str = "n.n_name") -> str:
    """Linear embedding (or interaction shares) per region/subset as SQL."""
    skip = set(spec.alloc) if skip is None else skip
    ordered = ordered or {}
    reals_on = reals_on and not pairs
    disc_on = disc_on and not pairs
    reals = [r for r in spec.real if r not in skip] if reals_on else []
    disc = [d for d in spec.discrete_all if d not in skip] if disc_on else []
    subsets = subsets or ["TRUE"]
    sub = " UNION ALL ".join(f"SELECT *, {i} AS subset FROM person WHERE coalesce({p}, FALSE)"
                             for i, p in enumerate(subsets))
    w = f"coalesce(CAST({spec.weight} AS DOUBLE), 0.0)"
    parts = [f"SELECT region, subset, '__w__' AS feature, CAST(NULL AS VARCHAR) AS level, "
             f"{w} AS val FROM ps"]
    parts += [f"SELECT region, subset, {q(r)}, NULL, {w} * {z_expr(r)} FROM ps" for r in reals]
    for d in disc:
        if d in ordered:
            levels = ordered[d]
            for k, lvl in enumerate(levels):
                higher = ", ".join(q(x) for x in levels[k:])
                parts.append(f"SELECT region, subset, {q(d)}, {q(lvl)}, {w} FROM ps "
                             f"WHERE CAST({d} AS VARCHAR) IN ({higher})")
        else:
            parts.append(f"SELECT region, subset, {q(d)}, {level_expr(d)}, {w} FROM ps")
    for d1, d2 in pairs or []:
        parts.append(f"SELECT region, subset, {q(d1 + '_' + d2)}, "
                     f"{level_expr(d1)} || '_' || {level_expr(d2)}, {w} FROM ps")
    valueless = ", ".join(q(x) for x in ["__w__"] + reals)
    entries = " UNION ALL ".join(parts)
    tail_cat = catalogue_cte(spec, set() if pairs else skip) + ","
    allw = " UNION ALL ".join(
        f"SELECT region, {i} AS subset, sum(CASE WHEN coalesce({p}, FALSE) THEN {w} ELSE 0.0 END) "
        f"AS weight FROM person GROUP BY region" for i, p in enumerate(subsets))
    grid = " UNION ALL ".join(
        f"SELECT {q(a + '_' + b)} AS feature, x.level || '_' || y.level AS level "
        f"FROM lv x, lv y WHERE x.feature = {q(a)} AND y.feature = {q(b)}" for a, b in pairs or [])
    # every level pair of every region and subset, zero where it does not occur
    final_pairs = f"""
SELECT a.region, a.subset, g.feature || '_' || g.level AS feature_name, g.feature AS feature_id,
       round(CASE WHEN a.weight = 0 THEN 0.0 ELSE coalesce(v.s, 0.0) / a.weight END, 6) AS value
FROM ({allw}) a CROSS JOIN ({grid}) g
LEFT JOIN vals v ON a.region IS NOT DISTINCT FROM v.region AND a.subset = v.subset
  AND g.feature = v.feature AND g.level = v.level"""
    final_lin = """
SELECT region, subset, pos, feature_name, feature_id,
       round(CASE WHEN weight = 0 THEN 0.0 ELSE s / weight END, 6) AS value
FROM vals v JOIN cat c ON v.feature = c.feature AND v.level IS NOT DISTINCT FROM c.level"""
    final_w = f"""
SELECT region, subset, round(weight, 6) AS weight FROM ({allw}) a"""
    if only_features:
        final_lin += " WHERE v.feature IN (" + ", ".join(q(f) for f in only_features) + ")"
    final = final_w if weight_out else (final_pairs if pairs else final_lin)
    return with_person(f"""
{stats_ctes(spec)},
{tail_cat}
ps AS ({sub}),
entries AS ({entries}),
sums AS (SELECT region, subset, feature, level, sum(val) AS s FROM entries
         WHERE val IS NOT NULL AND (level IS NOT NULL OR feature IN ({valueless}))
         GROUP BY region, subset, feature, level),
wts AS (SELECT region, subset, s AS weight FROM sums WHERE feature = '__w__'),
vals AS (SELECT s.*, coalesce(w.weight, 0.0) AS weight FROM sums s
         JOIN wts w ON s.region IS NOT DISTINCT FROM w.region AND s.subset = w.subset
         WHERE s.feature <> '__w__')
{final}""", region_expr)


def rff_sql(freqs, reals: list[str] | None = None, full: bool = False,
            condition: str | None = None, spec: MicrodataSpec = STANDIN,
            region_expr: str = "n.n_name", kind: str | None = None,
            ordered: dict[str, list[str]] | None = None, subsets: list[str] | None = None) -> str:
    """RFF mean embedding as SQL with literal frequencies.

    ``full``: all encoded features (frequency rows by catalogue position);
    otherwise the listed reals (frequency row i for real i), optionally per
    level of ``condition``.
    """
    D = len(freqs[0])
    fcols = ", ".join(f"f{j}" for j in range(D))
    fr_rows = ", ".join("(" + ", ".join([str(i)] + [repr(float(v)) for v in row]) + ")"
                        for i, row in enumerate(freqs))
    w = f"coalesce(CAST({spec.weight} AS DOUBLE), 0.0)"
    g = level_expr(condition) if condition else "CAST(NULL AS VARCHAR)"
    if full:
        skip = set(spec.alloc)
        rl = [r for r in spec.real if r not in skip]
        dl = [d for d in spec.discrete_all if d not in skip]
        feat = " UNION ALL ".join(
            [f"SELECT rid, c.pos, {z_expr(r)} AS x FROM pr JOIN cat c ON c.feature = {q(r)}"
             for r in rl]
            + [_thermo_feat(d, (ordered or {})[d]) if d in (ordered or {}) else
               f"SELECT rid, c.pos, 1.0 FROM pr JOIN cat c ON c.feature = {q(d)} "
               f"AND c.level = {level_expr(d)}" for d in dl])
        cat = catalogue_cte(spec, skip) + ","
    else:
        feat = " UNION ALL ".join(f"SELECT rid, {i} AS pos, {z_expr(r)} AS x FROM pr"
                                  for i, r in enumerate(reals))
        cat = catalogue_cte(spec, set()) + ","
    angles = ", ".join(f"sum(x * f{j}) AS a{j}" for j in range(D))
    aco = ", ".join(f"coalesce(a{j}, 0.0) AS a{j}" for j in range(D))
    sums = ", ".join([f"sum(w * sin(a{j})) AS s{j}" for j in range(D)]
                     + [f"sum(w * cos(a{j})) AS c{j}" for j in range(D)])
    where = "WHERE g IS NOT NULL" if condition else ""
    if full:
        prefix, fid = "'rff'", "'rff'"
    elif condition:
        ident = "_".join(reals)
        prefix, fid = f"{q(condition + '_' + ident + '_')} || g", q(f"{condition}_{ident}_rff")
    else:
        ident = "_".join(reals)
        prefix, fid = q(ident), q(ident + "_rff")
    lvl = ", g AS level" if condition else ""
    if kind:
        lvl += f", {q(kind)} AS kind"
    outs = []
    for j in range(2 * D):
        col = f"s{j}" if j < D else f"c{j - D}"
        nm = f"sin{j}" if j < D else f"cos{j - D}"
        outs.append(f"SELECT region, subset, {j} AS pos, {prefix} || '_{nm}' AS feature_name, "
                    f"{fid} AS feature_id, round(CASE WHEN coalesce(wt, 0) = 0 THEN 0.0 ELSE {col} / "
                    f"(wt * sqrt({D}.0)) END, 6) AS value{lvl} FROM dense")
    subs = " UNION ALL ".join(f"SELECT *, {i} AS subset FROM rowsx WHERE coalesce({p}, FALSE)"
                              for i, p in enumerate(subsets or ["TRUE"]))
    n_subsets = len(subsets or [0])
    groups = (f"SELECT level AS g FROM lv WHERE feature = {q(condition)}" if condition
              else "SELECT CAST(NULL AS VARCHAR) AS g")
    return with_person(f"""
{stats_ctes(spec)},
{cat}
pr AS (SELECT row_number() OVER () AS rid, region, {w} AS w, {g} AS g, * EXCLUDE (region)
       FROM person),
fr AS (SELECT * FROM (VALUES {fr_rows}) t(pos, {fcols})),
feat AS ({feat}),
ang AS (SELECT rid, {angles} FROM feat JOIN fr USING (pos) GROUP BY rid),
rowsx AS (SELECT pr.*, {aco} FROM pr LEFT JOIN ang USING (rid) {where}),
agg AS (SELECT region, subset, g, sum(w) AS wt, {sums} FROM ({subs}) s GROUP BY region, subset, g),
dense AS (SELECT d.region, d.subset, d.g, agg.* EXCLUDE (region, subset, g)
          FROM (SELECT * FROM (SELECT DISTINCT region FROM person) r
                CROSS JOIN (SELECT CAST(range AS INTEGER) AS subset FROM range({n_subsets})) t CROSS JOIN ({groups}) gs) d
          LEFT JOIN agg ON d.region IS NOT DISTINCT FROM agg.region AND d.subset = agg.subset
            AND d.g IS NOT DISTINCT FROM agg.g)
{' UNION ALL '.join(outs)}""", region_expr)


def _thermo_feat(d: str, levels: list[str]) -> str:
    """Thermometer rows: every level up to the row's own (none for others)."""
    lst = "[" + ", ".join(q(x) for x in levels) + "]"
    return (f"SELECT rid, c.pos, 1.0 FROM pr JOIN cat c ON c.feature = {q(d)} "
            f"AND list_position({lst}, c.level) IS NOT NULL "
            f"AND list_position({lst}, c.level) <= list_position({lst}, CAST({d} AS VARCHAR))")


def hash_uniform_sql(key: str) -> str:
    h = f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 15)) AS UBIGINT)"
    return f"(CASE WHEN {h} = 0 THEN pow(2.0, -61) ELSE CAST({h} AS DOUBLE) / pow(2.0, 60) END)"
