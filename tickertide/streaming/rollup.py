"""Continuous five-minute rollup."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickertide.functions.text import dedup_key
from tickertide.functions.time import utc_date
from tickertide.operators.merge import FEW_ROWS, insert_if_absent
from tickertide.operators.rollup import mention_authors, rollup_5m
from tickertide.operators.scoring import ScorerFactory, enrich, score_posts
from tickertide.operators.validate import has_ticker, validate_enriched, validate_raw
from tickertide.schema import ENRICHED_STORED, RAW_POST
from tickertide.sources.tables import (
    AUTHOR_TABLE,
    ENRICHED_TABLE,
    POST_KEYS,
    RAW_TABLE,
    ROLLUP_TABLE,
    commit_batch,
    committed,
    drop_merged_keys,
    read_batch,
    read_table,
    stored_keys,
    stored_runs,
    write_batch,
    write_keys,
)
from tickertide.streaming.dedup import dedup_stream_event_time

MAX_DAYS = 1000
# What the tables and the rollup need of an enriched post.
STORED = list(dict.fromkeys([*RAW_POST.fieldNames(), *ENRICHED_STORED]))


def rollup_stream(enriched: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Rollup of a stream with bounded lateness, for append mode.

    Both aggregation levels of ``rollup_5m`` run as chained stateful operators;
    a bucket is emitted once the watermark has passed it.
    """
    return rollup_5m(enriched.withWatermark("created_at", lateness), windowed=True)


def persist_and_roll(
    root: str, key_scope: str = "all", run: str | None = None, adopt: bool = False
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: store the posts, then add their rollup delta.

    No post is too late: each batch appends its own sums, and reading the rollup
    adds them up.  Author deltas only hold authors that earlier batches did not
    count.  Everything is derived from batches before this one and written to a
    folder named by the run and the batch id; copies of a post are picked in a total order.
    So a replayed batch changes nothing; one that is marked as complete is not written again.

    ``run`` names the stream; by default it is the id that its checkpoint holds. A new run
    (a fresh checkpoint) is refused on a root that holds batches of another one, unless it
    is told to ``adopt`` them as its history.

    A post is stored once, whatever its creation time says: its key is looked up in a narrow
    table of keys by hash, of which a batch opens the buckets it touches.  ``key_scope="day"``
    looks among the posts of the same creation days instead; right when a post keeps its
    creation time over redeliveries.

    The tables are written one after the other, and a mark last. Readers take marked batches
    only, so they see all of a batch or nothing of it.
    """
    if key_scope not in ("all", "day"):
        raise ValueError("key_scope is 'all' or 'day'")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = run or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "by-hand"
        others = stored_runs(spark, root) - {name}
        if others and not adopt and name not in stored_runs(spark, root):
            raise ValueError(f"{root} holds batches of {sorted(others)}; run {name} would mix with them")
        if committed(spark, root).get(name, -1) >= batch_id:
            return  # a replay of a batch that is complete
        before = (name, batch_id)
        posts = batch.select(*STORED).persist()
        try:
            if key_scope == "day":
                stored = _same_days(read_table(spark, root, ENRICHED_TABLE, before), posts, "created_at")
            else:
                stored = stored_keys(spark, root, posts, before)
            ordered = posts.withColumn("_order", F.xxhash64(F.to_json(F.struct(*STORED))))
            few = posts.count() <= FEW_ROWS
            fresh = insert_if_absent(stored, ordered, POST_KEYS, ["created_at", "_order"], few).drop("_order").persist()
            try:
                write_keys(fresh, root, name, batch_id)
                write_batch(fresh, root, RAW_TABLE, name, batch_id)
                write_batch(fresh, root, ENRICHED_TABLE, name, batch_id)
                mentioned = fresh.filter(has_ticker())
                known = read_table(spark, root, AUTHOR_TABLE, before)
                known = _same_days(known, mentioned, "created_at")
                keys = ["bucket_start", "ticker", "author_key"]
                # By sort: repeated authors make small files of many rows, too many for a broadcast.
                authors = mention_authors(mentioned).join(known.select(*keys).hint("merge"), keys, "left_anti")
                write_batch(authors, root, AUTHOR_TABLE, name, batch_id)
                # The new authors are found once: the rollup counts those just written.
                written = read_batch(spark, root, AUTHOR_TABLE, name, batch_id)
                write_batch(rollup_5m(mentioned, new_authors=written), root, ROLLUP_TABLE, name, batch_id)
                commit_batch(spark, root, name, batch_id)
                drop_merged_keys(spark, root, name, batch_id)
            finally:
                fresh.unpersist()
        finally:
            posts.unpersist()

    return write


def _same_days(table: DataFrame, posts: DataFrame, ts: str) -> DataFrame:
    """Prune a day-partitioned table to the days of the batch.

    A few days become a list of partitions, very many of them a range.
    """
    day = utc_date(ts).alias("day")
    days = [r.day for r in posts.select(day).distinct().limit(MAX_DAYS + 1).collect()]
    if len(days) <= MAX_DAYS:
        return table.filter(F.col("day").isin(days))
    span = posts.select(day).agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    return table.filter(F.col("day").between(span.a, span.b))


def start_rollup(
    enriched: DataFrame,
    root: str,
    checkpoint: str,
    key_scope: str = "all",
    trigger: dict | None = None,
    quarantine: str | None = None,
    adopt: bool = False,
) -> StreamingQuery:
    """Run ``persist_and_roll`` over a stream of enriched posts.

    Rows that are not valid are written with their errors below ``quarantine``, one folder
    per batch. The default trigger is one batch a minute.
    """
    roll = persist_and_roll(root, key_scope, adopt=adopt)

    def run(batch: DataFrame, batch_id: int) -> None:
        good, bad = validate_enriched(batch)
        if quarantine:
            bad.write.mode("overwrite").json(f"{quarantine}/batch_id={batch_id}")
        roll(good, batch_id)

    return (
        enriched.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def enrich_stream(
    raw: DataFrame,
    make_scorers: ScorerFactory,
    allow: DataFrame | Iterable[str] | None = None,
    dedup: Callable[[DataFrame], DataFrame] = dedup_stream_event_time,
    quarantine: str | None = None,
    trigger: dict | None = None,
) -> DataFrame:
    """Raw stream to enriched stream: validate, dedup, score, enrich.

    No post is dropped for lateness. With ``quarantine`` a second query writes the rows that
    are not valid, with their errors, below that folder.
    """
    good, bad = validate_raw(raw)
    if quarantine:
        (
            bad.writeStream.format("json")
            .option("path", quarantine)
            .option("checkpointLocation", f"{quarantine}/_checkpoint")
            .trigger(**(trigger or {"processingTime": "1 minute"}))
            .start()
        )
    fresh = dedup(good.withColumn("dedup_key", dedup_key("url", "text")))
    return enrich(score_posts(fresh, make_scorers), allow)
