"""Roll-up of region embeddings to coarser targets.

A target's embedding is the weight-weighted mean of its regions'
embeddings: ``sum_r w_r v_r / sum_r w_r`` per ``(target, subset, pos)``;
target weights are the summed region weights and a zero-weight target gets
zeros.  Values are long-form and sparse (absent = 0), so the numerator sums
only present entries while the denominator is the target's full weight.

Embeddings whose weight is per level (conditional RFF, A13) carry that
level in their weights table; it is then part of the key, so each level is
rolled up by its own weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.functions.geo import state_of_region
from regemb.operators.embed import Embedding
from regemb.operators.regions import strict_map


def _join_ns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join on ``keys`` where null keys match null keys."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, cond, "inner").drop(*[f"_r_{k}" for k in keys])


def _keys(emb: Embedding) -> list[str]:
    return [c for c in emb.weights.columns if c not in ("region", "weight")]


def rollup(emb: Embedding, target: Column | None = None,
           mapping: DataFrame | None = None, mapping_value: str = "merged_region",
           out_col: str = "region") -> Embedding:
    """Roll ``emb`` up to ``target`` (a Column over ``region``) or a
    strict ``mapping`` table ``(region, <mapping_value>)`` (J7)."""
    keys = _keys(emb)
    w = emb.weights
    if mapping is not None:
        w = strict_map(w, mapping, "region", mapping_value).withColumn("_t", F.col(mapping_value))
    else:
        w = w.withColumn("_t", target)
    w = w.select("region", *keys, "_t", "weight")
    desc = [c for c in emb.values.columns if c not in ["region", "value", "pos"] + keys]
    v = _join_ns(emb.values, w, ["region"] + keys)
    num = (v.groupBy("_t", *keys, "pos", *desc)
            .agg(F.sum(F.col("weight") * F.col("value")).alias("_num")))
    tw = w.groupBy("_t", *keys).agg(F.sum("weight").alias("weight"))
    vals = (_join_ns(num, tw, ["_t"] + keys)
               .select(F.col("_t").alias(out_col), *keys, "pos", *desc,
                       F.coalesce(F.try_divide(F.col("_num"), F.col("weight")),
                                  F.lit(0.0)).alias("value")))
    return Embedding(vals, tw.withColumnRenamed("_t", out_col), emb.kind)


def state_rollup(emb: Embedding) -> Embedding:
    """target = first two characters of the region name."""
    return rollup(emb, target=state_of_region("region"))


def superregion_rollup(emb: Embedding, mapping: DataFrame,
                       value: str = "merged_region") -> Embedding:
    """Target from a strict region -> super-region table."""
    return rollup(emb, mapping=mapping, mapping_value=value)


def rollup_all(embs: list[Embedding], target: Column | None = None,
               mapping: DataFrame | None = None) -> list[Embedding]:
    """Every embedding kind rolled up the same way."""
    return [rollup(e, target, mapping) for e in embs]
