"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickertide.llm.tables import discard, stage


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the least neighbour of u; a hub's pairs are split by the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = _with_least(both).withColumn("m", F.least("m", "u"))
    return seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = _with_least(down)
    moved = seen.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(seen.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for each id on an edge but the least of a component itself.

    ``edges`` has two long columns ``u`` and ``v``; order, repeats and loops don't matter,
    and rows with a null are left out. ``component`` is the least id that can be reached.
    Each round is a written table, so a lost executor costs one round at most.
    """
    clean = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stage(clean.distinct(), "components")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not seen[0]:
            found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            found.staged_at = now.staged_at
            return found
        mark, before = seen, now
        now = stage(_small_star(_large_star(now).distinct()).distinct(), "components")
        discard(before)
