"""Consolidating pairwise matches into groups by randomised contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.plans.scratch import cut, release


def connected_groups(pairs: DataFrame, left: Column, right: Column, scope: Column | None = None, max_rounds: int = 60) -> DataFrame:
    """Group identifier of every linked vertex: scope, unit_id, group_id (the group's smallest vertex).

    Method: randomised contraction. In each round every vertex hooks to the vertex with the smallest
    fresh hash in its closed neighbourhood; edges are relabelled by the hooks, loops and repeats
    dropped. Each round removes a constant share of the vertices in expectation, so the tables shrink
    geometrically and a billion pairs need some tens of rounds. The hooks are then expanded from the
    last round back to the first, carrying each group's smallest vertex.

    Hooking is a ``min_by`` aggregate with map-side combining, and no neighbour list is ever built. Relabelling
    joins the edges with one row per vertex, so a hub's edges are skewed on one side only, which adaptive
    execution splits. Each round is written to the shared folder, so lost executors only re-read.

    Defined results: pairs with a null end or null scope take no part; a vertex paired only with itself
    is its own group; repeated and reversed pairs count once; an empty table gives no rows.
    """
    key = scope if scope is not None else F.lit("")
    raw = pairs.select(key.alias("s"), left.cast("long").alias("u"), right.cast("long").alias("v")).where("s is not null and u is not null and v is not null")
    raw = cut(raw.select("s", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    spark = pairs.sparkSession
    hooks: list[DataFrame] = []  # of each round: s, v, r (the hook), m (smallest original vertex below v)
    edges, least = raw.where("u <> v"), None
    for seed in range(max_rounds):
        if edges.isEmpty():
            release(edges)
            break
        both = edges.select("s", "u", F.col("v").alias("w")).unionByName(edges.select("s", F.col("v").alias("u"), F.col("u").alias("w")))
        h = F.xxhash64("w", F.lit(seed))
        near = both.groupBy("s", "u").agg(F.min(h).alias("h"), F.min_by("w", h).alias("w"))
        own = F.xxhash64("u", F.lit(seed))
        near = near.select("s", F.col("u").alias("v"), F.when(own <= F.col("h"), F.col("u")).otherwise(F.col("w")).alias("r"))
        near = near.withColumn("m", F.col("v")) if least is None else near.join(least, ["s", "v"])
        hook = cut(near, "hooks")
        hooks.append(hook)
        least = hook.groupBy("s", F.col("r").alias("v")).agg(F.min("m").alias("m"))
        a = hook.select("s", F.col("v").alias("u"), F.col("r").alias("ru"))
        b = hook.select("s", "v", F.col("r").alias("rv"))
        new = edges.join(a, ["s", "u"]).join(b, ["s", "v"]).where("ru <> rv")
        new = cut(new.select("s", F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        release(edges)  # does nothing for the first, which is not a table of its own
        edges = new
    else:
        if not edges.isEmpty():
            raise RuntimeError(f"contraction left edges after {max_rounds} rounds")

    # Expand from the last round back: the least vertex of a hook that no later round contracts is final.
    group = None
    for hook in reversed(hooks):
        final = hook.groupBy("s", F.col("r").alias("x")).agg(F.min("m").alias("own"))
        if group is not None:
            final = final.join(group.select("s", F.col("v").alias("x"), "g"), ["s", "x"], "left").select("s", "x", F.coalesce("g", "own").alias("own"))
        before = group
        group = cut(hook.join(final.withColumnRenamed("x", "r"), ["s", "r"]).select("s", "v", F.col("own").alias("g")), "groups")
        release(hook)
        if before is not None:
            release(before)
    loops = raw.where("u = v").select("s", "v", F.col("v").alias("g"))
    if group is not None:
        loops = loops.join(group.select("s", "v"), ["s", "v"], "left_anti")
        loops = group.select("s", "v", "g").unionByName(loops)
    return loops.select(F.col("s").alias("scope"), F.col("v").alias("unit_id"), F.col("g").alias("group_id"))
