"""Connected components of bipartite place graphs and region naming.

Regions are the connected components of the county-PUMA overlap graph.
Components are found with the alternating *large-star / small-star*
contraction (Kiveris et al., "Connected Components in MapReduce and
Beyond", SoCC 2014): each round is a pair of groupBy/join steps on the edge
list and the number of rounds grows like log^2 of the component size, so a
long chain needs a handful of rounds, not one per hop.  After convergence
every component is a star around its smallest node, which is the label.

Nodes are numbered first, in their own order, so every round shuffles pairs
of 64-bit numbers whatever the keys look like.

Every step's edge list is written to the folder that ``spark.checkpoint.dir``
names, which cuts the lineage and lets a lost executor's work be re-read
rather than recomputed from the first round; count and checksum of the edges
are observed by the same write.  High-degree nodes (a hub holding a third of
the edges) only meet partial aggregation in ``groupBy(u).min`` and, in the
large star, a join of two stored tables, whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from regemb.functions.geo import region_name
from regemb.session import stored


def _observed(df: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """``df`` stored, with the number of its edges and the sum of their hashes."""
    seen = Observation()
    told = df.observe(seen, F.count(F.lit(1)).alias("n"),
                      F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    kept = stored(told, f"graph-{name}")
    return kept, (int(seen.get["n"]), int(seen.get["h"] or 0))


def _both(e: DataFrame) -> DataFrame:
    return (e.select(F.col("a").alias("u"), F.col("b").alias("v"))
             .unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))))


def _smallest(b: DataFrame) -> DataFrame:
    return b.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def large_star(e: DataFrame) -> DataFrame:
    """Connect every strictly larger neighbour of u to u's smallest neighbourhood node.

    The minima are stored: a join of two plain scans shuffles both sides,
    which is what lets AQE split a hub's partition (it cannot split below an
    aggregate).
    """
    b = _both(e)
    return (b.join(stored(_smallest(b), "graph-minima"), "u").where(F.col("v") > F.col("u"))
             .select(F.col("v").alias("a"), F.col("m").alias("b"))
             .where(F.col("a") != F.col("b")).distinct())


def small_star(e: DataFrame) -> DataFrame:
    """Connect u and its smaller neighbours to the smallest of them.

    After a large star a node's smaller neighbours are few (minima of its
    neighbours), so this join has no hub.
    """
    b = _both(e).where(F.col("v") <= F.col("u"))
    m = _smallest(b)
    moved = b.join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = m.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own).where(F.col("a") != F.col("b")).distinct()


def _components(e0: DataFrame) -> DataFrame:
    """``(node, component)`` of stored edges ``a <= b`` between numbers; a self-loop keeps its node."""
    e = e0.where(F.col("a") != F.col("b"))
    sig = (-1, 0)
    while True:
        large = stored(large_star(e), "graph-large")
        e, new = _observed(small_star(large), "small")
        if new == sig or not new[0]:
            break
        sig = new
    # at the end every edge leads from a node to its component's smallest one
    parent = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    alone = (e0.select(F.col("a").alias("node")).union(e0.select("b")).distinct()
               .join(parent, "node", "left"))
    return alone.select("node", F.coalesce("component", "node").alias("component"))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list.

    Node ids may be any orderable type; the component label is the smallest
    node of the component.  Rounds go on until nothing moves.  Edges with a
    null end are left out.
    """
    pairs = (edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
                  .select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct())
    if dict(pairs.dtypes)["a"] == "bigint":
        return _components(stored(pairs, "graph-edges"))
    pairs = stored(pairs, "graph-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # the numbers rise with the ranges and inside them, so they order as the nodes do
    number = stored(nodes.repartitionByRange("node").sortWithinPartitions("node")
                         .withColumn("id", F.monotonically_increasing_id()), "graph-nodes")
    first = number.select(F.col("node").alias("a"), F.col("id").alias("ia"))
    second = number.select(F.col("node").alias("b"), F.col("id").alias("ib"))
    edges0 = stored(pairs.join(first, "a").join(second, "b")
                         .select(F.col("ia").alias("a"), F.col("ib").alias("b")), "graph-edges")
    found = _components(edges0)
    named = number.select("id", F.col("node").alias("name"))
    return (found.join(number, found["node"] == number["id"])
                 .select(number["node"].alias("node"), "component")
                 .join(named, F.col("component") == named["id"])
                 .select("node", F.col("name").alias("component")))


LEFT, RIGHT, HUB = "L:", "R:", "H:"


def bipartite_components(pairs: DataFrame, left: str, right: str,
                         forced: dict[str, DataFrame] | None = None) -> DataFrame:
    """G1 (+G2): components of left-right pairs, as ``(side, key, component)``.

    Left and right keys are namespaced (``L:``/``R:``) so equal codes on the
    two sides stay distinct nodes.  ``forced`` maps a hub name to a table of
    left keys that must share one component (every component touching them
    becomes one, e.g. all of Alaska); this adds hub edges before the search,
    which gives the same result as merging afterwards.
    """
    lk = F.concat(F.lit(LEFT), F.col(left).cast("string"))
    rk = F.concat(F.lit(RIGHT), F.col(right).cast("string"))
    e = pairs.select(lk.alias("a"), rk.alias("b"))
    for hub, keys in (forced or {}).items():
        col = keys.columns[0]
        e = e.unionByName(keys.select(F.concat(F.lit(LEFT), F.col(col).cast("string")).alias("a"),
                                      F.lit(HUB + hub).alias("b")))
    cc = connected_components(e)
    return (cc.where(~F.col("node").startswith(HUB))
              .select(F.when(F.col("node").startswith(LEFT), F.lit("left"))
                      .otherwise(F.lit("right")).alias("side"),
                      F.substr(F.col("node"), F.lit(3)).alias("key"),
                      "component"))


class ComponentStateError(ValueError):
    pass


def name_regions(members: DataFrame, state: str, yy: str, stab: DataFrame | None = None,
                 ) -> DataFrame:
    """W1 + G3: name components ``<stab>_<yy>_<nn>`` per state.

    ``members`` has ``(side, key, component, <state>)`` (state may be null on
    nodes that carry none).  A component must lie in one state (else error); components are numbered within their state in
    order of their smallest left key.  Returns ``(component, state, region)``.
    """
    comp = (members.groupBy("component")
            .agg(F.count_distinct(state).alias("n_states"), F.max(state).alias(state),
                 F.min(F.when(F.col("side") == "left", F.col("key"))).alias("first_key")))
    bad = comp.where(F.col("n_states") > 1).limit(1).collect()
    if bad:
        raise ComponentStateError(f"component {bad[0]['component']!r} spans several states")
    w = Window.partitionBy(state).orderBy("first_key", "component")
    named = comp.withColumn("nn", F.row_number().over(w))
    label = F.col(state).cast("string")
    if stab is not None:
        named = named.join(stab, state, "left")
        label = F.coalesce(F.col("stab"), label)
    return named.select("component", state, region_name(label, yy, "nn").alias("region"))


def membership(members: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """``left -> region`` and ``right -> region`` lookup tables, sorted by key."""
    j = members.join(names.select("component", "region"), "component")
    return {
        "left": j.where(F.col("side") == "left").select(F.col("key"), "region").orderBy("key"),
        "right": j.where(F.col("side") == "right").select(F.col("key"), "region").orderBy("key"),
    }


def superregions(edges_by_era: list[DataFrame], left: str = "county",
                 region: str = "region") -> DataFrame:
    """Components over the union of several eras' county -> region edges.

    Returns ``(side, key, component)``; name them with ``name_regions`` and
    ``yy="merged"``.
    """
    u = edges_by_era[0].select(left, region)
    for e in edges_by_era[1:]:
        u = u.unionByName(e.select(left, region))
    return bipartite_components(u, left, region)
