"""Incremental loads: what is new since a cursor, and where the cursor moves."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickertide.functions.time import instant, iso_z

# Rows taken per load.
SOCIAL_LIMIT = 50
NEWS_LIMIT = 200
BROADCAST_STREAMS = 1_000_000


def newest_per_batch(
    df: DataFrame, stream: str, order: list[str], limit: int = SOCIAL_LIMIT
) -> DataFrame:
    """The newest ``limit`` rows of each stream.

    Spark cuts every map task to ``limit`` rows per stream before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy(stream).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def since_cursor(
    df: DataFrame, cursors: DataFrame, stream: str, id_col: str, order: list[str]
) -> DataFrame:
    """Rows newer than the cursor row of their stream.

    A stream without a cursor, or whose cursor row is not in ``df``, keeps all
    its rows.  ``cursors`` has columns (``stream``, ``cursor``).
    """
    place = F.struct(*[F.col(c) for c in order])
    # One row per stream: broadcast, neither join moves the rows of a busy stream.
    few = cursors.limit(BROADCAST_STREAMS + 1).count() <= BROADCAST_STREAMS
    cursors = F.broadcast(cursors) if few else cursors
    at = (
        df.join(
            cursors.select(stream, F.col("cursor").alias(id_col)), [stream, id_col], "left_semi"
        )
        .groupBy(stream)
        .agg(F.max(place).alias("_at"))
    )
    return (
        df.join(F.broadcast(at) if few else at, stream, "left")
        .filter(F.col("_at").isNull() | (place > F.col("_at")))
        .drop("_at")
    )


def oldest_first(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*order)


def since_watermark(df: DataFrame, ts: str, since: datetime | str | None) -> DataFrame:
    """Rows strictly later than ``since``; rows without a time are dropped."""
    known = df.filter(F.col(ts).isNotNull())
    return known if since is None else known.filter(F.col(ts) > instant(since))


def cap_oldest(df: DataFrame, ts: str, ids: list[str], n: int = NEWS_LIMIT) -> DataFrame:
    """The oldest ``n`` rows (the rest is left behind, see ``advance_cursor``)."""
    return df.orderBy(ts, *ids).limit(n)


def advance_cursor(df: DataFrame, stream: Column | str, order: list[str], cursor: Column) -> DataFrame:
    """The cursor of the newest row of each stream."""
    stream_id = (stream if isinstance(stream, Column) else F.col(stream)).alias("stream_id")
    newest = F.max_by(cursor, F.struct(*order)).alias("cursor")
    return df.groupBy(stream_id).agg(newest)


def social_cursor(df: DataFrame, subreddit: str = "subreddit") -> DataFrame:
    """The newest id per subreddit."""
    return advance_cursor(
        df, F.concat(F.lit("reddit:"), F.col(subreddit)), ["created_at", "post_id"], F.col("post_id")
    ).select(F.lit("reddit").alias("source"), "stream_id", "cursor")


def news_cursor(df: DataFrame, stream: str = "news:default") -> DataFrame:
    """The newest publication time, as ISO text."""
    newest = df.agg(F.max("created_at").alias("newest")).filter(F.col("newest").isNotNull())
    return newest.select(
        F.lit("news").alias("source"), F.lit(stream).alias("stream_id"), iso_z("newest").alias("cursor")
    )


def merge_cursors(store: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert by (source, stream_id): the latest ``updated_at`` wins."""
    latest = F.max_by(F.struct("cursor", "updated_at"), F.struct("updated_at", "_new")).alias("c")
    both = store.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return both.groupBy("source", "stream_id").agg(latest).select("source", "stream_id", "c.*")
