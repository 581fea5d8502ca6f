"""Time-to-live dedup of a stored table: first seen wins, a hit does not refresh."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickertide.session import stage_table

# Fixed value: how long a key blocks its copies.
TTL_SECONDS = 3600
# Keys with more distinct instants than this are split over many tasks.
HOT_ROWS = 2_000_000
BROADCAST_KEYS = 1_000_000
# Hot keys are cut into cells of time, about ttl / CELLS_PER_TTL wide.
CELLS_PER_TTL = 16
MAX_CELLS = 1_000_000


def dedup_batch_ttl(
    df: DataFrame,
    key: str,
    ts: str,
    ids: list[str],
    ttl_seconds: float = TTL_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Keep a row unless its key was kept at most ``ttl_seconds`` earlier.

    Rows are taken in (ts, ids) order; (key, ts, ids) names a row, and identical
    redeliveries of it count once.  The decision runs on (key, ts, ids) alone,
    so texts move once, in the final semi join.  A row without a key or a time can't
    repeat another: all such rows are kept.  Ids may be null.
    """
    ruled = F.col(key).isNotNull() & F.col(ts).isNotNull()
    slim = (
        df.where(ruled).select(F.col(key).alias("k"), F.unix_micros(ts).alias("us"), F.struct(*ids).alias("id"))
        .groupBy("k", "us")
        .agg(F.min("id").alias("id"))
    )
    kept = _kept_instants(stage_table(slim, "ttl"), int(ttl_seconds * 1_000_000), hot_rows)
    survivors = kept.select(
        F.col("k").alias(key), F.timestamp_micros("us").alias(ts), *[F.col(f"id.{i}").alias(i) for i in ids]
    )
    names = [key, ts, *ids]
    renamed = survivors.withColumnsRenamed({n: f"_{n}" for n in names})
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    # The survivors first: copies of a row then collapse among few rows.
    kept = df.where(ruled).join(renamed, same, "left_semi").dropDuplicates(names)
    return kept.unionByName(df.where(~ruled))


def _kept_instants(slim: DataFrame, ttl: int, hot_rows: int) -> DataFrame:
    """The kept (k, us, id) of distinct (k, us) rows."""
    hot = stage_table(
        slim.groupBy("k").count().filter(F.col("count") > hot_rows).select("k"), "hot-keys"
    )
    n_hot = hot.count()
    if n_hot == 0:
        return _walk(slim, ttl)
    if n_hot <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    usual = _walk(slim.join(hot, "k", "left_anti"), ttl)
    heavy = slim.join(hot, "k", "left_semi")
    orbit = _orbit(stage_table(heavy.select("k", "us"), "hot-rows"), ttl)
    return usual.unionByName(heavy.join(orbit, ["k", "us"], "left_semi"))


def _walk(slim: DataFrame, ttl: int) -> DataFrame:
    """The kept rows of keys whose instants fit a sorted pass.

    A row more than the ttl after its predecessor is always kept and starts the rule anew,
    which cuts a key into islands in the JVM. An island no longer than the ttl keeps its first
    row; only the longer ones are walked in Python, with constant memory.
    """
    by_key = W.partitionBy("k").orderBy("us")
    starts = F.coalesce(F.col("us") - F.lag("us").over(by_key) > ttl, F.lit(True))
    heads = slim.withColumn("_starts", starts)
    heads = heads.withColumn("_head", F.max(F.when(F.col("_starts"), F.col("us"))).over(by_key))
    far = heads.withColumn("_far", F.max("us").over(W.partitionBy("k", "_head")) - F.col("_head") > ttl)
    short = far.where(~F.col("_far") & F.col("_starts")).select(*slim.columns)
    walked = _walk_islands(far.where("_far").select(*slim.columns, "_head"), ttl)
    return short.unionByName(walked.select(*slim.columns))


def _walk_islands(rows: DataFrame, ttl: int) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, last_kept = None, None
        for batch in batches:
            mask = []
            for k, head, us in zip(*(batch[c].to_pylist() for c in ("k", "_head", "us"))):
                keep = (k, head) != island or us - last_kept > ttl
                if keep:
                    island, last_kept = (k, head), us
                mask.append(keep)
            yield batch.filter(pa.array(mask, pa.bool_()))

    ordered = rows.repartition("k", "_head").sortWithinPartitions("k", "_head", "us")
    return ordered.mapInArrow(step, ordered.schema)


def _orbit(nodes: DataFrame, ttl: int) -> DataFrame:
    """Kept (k, us) of very frequent keys, by pointer doubling.

    Every instant points at the next one more than ``ttl`` later; the kept ones
    are those reached from the first.  Doubling the pointers reaches a chain of
    n kept rows in log2(n) rounds of equi-joins on (k, us), which spread a single
    key over all tasks.
    """
    jumps = stage_table(_next_after_ttl(nodes, ttl), "jumps")
    reached = stage_table(nodes.groupBy("k").agg(F.min("us").alias("us")), "reached")
    while True:
        found = stage_table(
            reached.join(jumps, ["k", "us"]).select("k", F.col("nxt").alias("us")), "found"
        )
        if found.isEmpty():
            return reached
        reached = stage_table(reached.unionByName(found), "reached")
        ahead = jumps.select("k", F.col("us").alias("nxt"), F.col("nxt").alias("far"))
        jumps = stage_table(
            jumps.join(ahead, ["k", "nxt"]).select("k", "us", F.col("far").alias("nxt")), "jumps"
        )


def _next_after_ttl(nodes: DataFrame, ttl: int) -> DataFrame:
    """(k, us, nxt): the first instant of the key later than ``us + ttl``.

    Any cell width gives the same answer; narrow cells split a key over more
    tasks, and ``MAX_CELLS`` bounds what the window over the cells of a key holds.
    """
    first, last = nodes.agg(F.min("us"), F.max("us")).first()
    width = max(1, ttl // CELLS_PER_TTL, (last - first) // MAX_CELLS)
    cell = F.floor(F.col("pos") / F.lit(width)).alias("cell")
    targets = nodes.select("k", F.col("us").alias("pos"), F.lit(0).alias("asks"), "us")
    questions = nodes.select("k", (F.col("us") + ttl).alias("pos"), F.lit(1).alias("asks"), "us")
    both = targets.unionByName(questions).select("*", cell)
    # Descending, a question meets exactly the targets behind its position.
    down = W.partitionBy("k", "cell").orderBy(F.desc("pos"), F.desc("asks"))
    instant = F.when(F.col("asks") == 0, F.col("us"))
    inside = both.withColumn("near", F.last(instant, ignorenulls=True).over(down))
    # One row per (key, cell).
    cells = both.groupBy("k", "cell").agg(F.min(instant).alias("first"))
    later = W.partitionBy("k").orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("k", "cell", F.last("first", ignorenulls=True).over(later).alias("far"))
    answered = inside.filter(F.col("asks") == 1).join(cells, ["k", "cell"])
    return answered.select("k", "us", F.coalesce("near", "far").alias("nxt")).filter(
        F.col("nxt").isNotNull()
    )
