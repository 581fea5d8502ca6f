"""Batch backfill: raw posts to enriched posts to the rollup."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickertide.functions.text import dedup_key
from tickertide.functions.time import between, utc_date
from tickertide.operators.dedup import TTL_SECONDS, dedup_batch_ttl
from tickertide.operators.rollup import rollup_5m
from tickertide.operators.scoring import ScorerFactory, enrich, score_posts
from tickertide.operators.validate import has_ticker, validate_raw
from tickertide.schema import ROLLUP
from tickertide.sources.tables import ENRICHED_TABLE, POST_KEYS, RAW_TABLE, RECOMPUTED_TABLE, read_table

HOUR_MICROS = 3_600_000_000


def enrich_backlog(
    raw: DataFrame,
    make_scorers: ScorerFactory,
    allow: DataFrame | Iterable[str] | None = None,
    ttl_seconds: float = TTL_SECONDS,
    quarantine: str | None = None,
) -> DataFrame:
    """Validate, drop reposts by the replayable time-to-live rule, score and enrich.

    Rows that are not valid are written with their errors to ``quarantine``.
    """
    good, bad = validate_raw(raw)
    if quarantine:
        bad.write.mode("overwrite").json(quarantine)
    keyed = good.withColumn("dedup_key", dedup_key("url", "text"))
    fresh = dedup_batch_ttl(keyed, "dedup_key", "created_at", ["source", "post_id"], ttl_seconds)
    return enrich(score_posts(fresh, make_scorers), allow)


def rebuild_rollup(enriched: DataFrame) -> DataFrame:
    """The rollup of enriched posts, each post counted once."""
    return rollup_5m(_one_each(enriched))


def _one_each(posts: DataFrame) -> DataFrame:
    """One row of each post. The rows are sorted by key; a hash in front settles nearly all comparisons."""
    return posts.withColumn("_hash", F.xxhash64(*POST_KEYS)).dropDuplicates(["_hash", *POST_KEYS])


def _with_author(posts: DataFrame, raw: DataFrame) -> DataFrame:
    """Stored posts with the author that the raw table holds.

    Both sides hold a row for each post, so they are joined by sort. Spark's estimate of the authors, a few
    columns cut out of wide rows, is far too small, and their broadcast would fill the driver.
    """
    keys = ["_hash", *POST_KEYS]
    authors = _one_each(raw.select(*POST_KEYS, "author"))
    hashed = posts.drop("author").withColumn("_hash", F.xxhash64(*POST_KEYS))
    return hashed.join(authors.hint("merge"), keys, "left")


def rebuild_from_tables(spark: SparkSession, root: str) -> DataFrame:
    """The rollup from the stored posts alone; the author of a post is in the raw table."""
    posts = read_table(spark, root, ENRICHED_TABLE)
    return rebuild_rollup(_with_author(posts, read_table(spark, root, RAW_TABLE)))


def touched_hours(posts: DataFrame) -> list[datetime]:
    """The hours (UTC) whose buckets posts with a ticker fall into, in order."""
    hour = F.timestamp_micros(F.unix_micros("created_at") - F.pmod(F.unix_micros("created_at"), F.lit(HOUR_MICROS)))
    rows = posts.where(has_ticker()).select(F.unix_seconds(hour).alias("s")).distinct().collect()  # hours, few
    return [datetime.fromtimestamp(r.s, timezone.utc) for r in sorted(rows)]


def recompute_touched(spark: SparkSession, root: str, hours: list[datetime]) -> None:
    """Recompute the rollup of some hours from the stored posts, and replace just those parts.

    For corrections and late batches where a plain table of final rows is wanted beside the
    deltas: ``touched_hours`` of a batch says which hours it concerns. Only the days of these
    hours are opened, only rows of these hours pass the scan, and a dynamic partition overwrite
    replaces the parts (day, hour) and leaves the others as they are.
    """
    if not hours:
        return
    within = _in_hours("created_at", hours)
    days = F.col("day").isin(sorted({h.date() for h in hours}))
    raw, posts = (read_table(spark, root, t).where(days & within) for t in (RAW_TABLE, ENRICHED_TABLE))
    rows = rebuild_rollup(_with_author(posts, raw))
    parted = rows.withColumns({"day": utc_date("bucket_start"), "hour": _hour("bucket_start")})
    (
        parted.hint("rebalance", "day", "hour")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "hour")
        .parquet(f"{root}/{RECOMPUTED_TABLE}")
    )


def _hour(ts: str) -> Column:
    return F.floor(F.pmod(F.unix_micros(ts), F.lit(24 * HOUR_MICROS)) / HOUR_MICROS).cast("int")


def _in_hours(ts: str, hours: list[datetime]) -> Column:
    """Runs of neighbouring hours as ranges, which reach the scan as pushed filters."""
    runs: list[list[datetime]] = []
    for hour in sorted(hours):
        if runs and hour == runs[-1][1]:
            runs[-1][1] = hour + timedelta(hours=1)
        else:
            runs.append([hour, hour + timedelta(hours=1)])
    return reduce(Column.__or__, [between(ts, a, b) for a, b in runs])


def read_recomputed(spark: SparkSession, root: str) -> DataFrame:
    """The rows that ``recompute_touched`` has written."""
    schema = T.StructType(ROLLUP.fields + [T.StructField("day", T.DateType()), T.StructField("hour", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/{RECOMPUTED_TABLE}").select(*ROLLUP.fieldNames())
