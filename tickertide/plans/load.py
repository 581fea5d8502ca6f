"""Incremental loads: landed payloads to new posts, to a topic, and the cursor after them."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickertide.functions.time import iso_z, parse_iso_utc
from tickertide.operators.cursors import (
    merge_cursors,
    news_cursor,
    newest_per_batch,
    since_cursor,
    social_cursor,
)
from tickertide.schema import CURSORS, RAW_POST
from tickertide.session import stage_table
from tickertide.sources.payloads import news_to_raw, social_to_raw
from tickertide.sources.topics import write_raw_posts

NEWS_STREAM = "news:default"
MALFORMED_STREAM = "news:malformed:"  # and the id of an article without a place in time


def read_cursors(spark: SparkSession, path: str) -> DataFrame:
    """The cursor table: of each (source, stream_id) the row of the latest update."""
    try:
        rows = spark.read.schema(CURSORS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CURSORS)
    return merge_cursors(rows.limit(0), rows)


def write_cursors(updates: DataFrame, path: str, at: datetime) -> None:
    """Append updates (source, stream_id, cursor); the latest one of a stream counts."""
    stamped = updates.select("source", "stream_id", "cursor", F.lit(at).cast("timestamp").alias("updated_at"))
    stamped.write.mode("append").parquet(path)


def load_social(items: DataFrame, topic: str, cursors: str, at: datetime, newest: int | None = None) -> None:
    """Publish the listing items that are newer than the cursor of their subreddit, oldest first.

    Items without a subreddit are left out. ``newest`` keeps that many of each subreddit and
    loses the rest, as a poll of a listing does; by default nothing is lost. The cursor
    moves once the posts are published, so a failed load is repeated, never skipped.
    """
    spark = items.sparkSession
    raw = social_to_raw(items.where(F.trim(F.coalesce("subreddit", F.lit(""))) != ""))
    raw = raw.withColumn("subreddit", F.col("meta")["subreddit"].cast("string"))
    known = read_cursors(spark, cursors).where("source = 'reddit'")
    known = known.select(F.expr("substring(stream_id, 8)").alias("subreddit"), "cursor")
    fresh = since_cursor(raw, known, "subreddit", "post_id", ["created_at", "post_id"])
    if newest is not None:
        fresh = newest_per_batch(fresh, "subreddit", ["created_at", "post_id"], newest)
    fresh = stage_table(fresh, "load-social")
    write_raw_posts(fresh.drop("subreddit").orderBy("created_at", "post_id"), topic)
    write_cursors(social_cursor(fresh), cursors, at)


def load_news(
    responses: DataFrame, topic: str, cursors: str, at: datetime, oldest: int | None = None
) -> None:
    """Publish the articles that are later than the newest published one, oldest first.

    Responses without a query and articles without a time (blank ones too) are left out.
    ``oldest`` ends a load after about that many articles, at a time that no article shares with
    the rest; the cursor is the newest published time, so the rest comes with the next load.
    Articles whose time can't be parsed have no place in that order: they are published last,
    whatever the cursor and ``oldest`` say, with the text of their time, and end in the
    quarantine of the next job. Their ids are kept as cursors of their own, so that each is
    published once.
    """
    spark = responses.sparkSession
    raw = news_to_raw(responses.where(F.trim(F.coalesce("query", F.lit(""))) != ""), published=True)
    known = read_cursors(spark, cursors).where("source = 'news'")
    since = known.where(F.col("stream_id") == NEWS_STREAM).select(F.max(parse_iso_utc("cursor"))).first()[0]
    raw = raw.where(F.col("published").rlike(r"\S"))
    new = F.size("bad_times") > 0
    timed = F.col("created_at").isNotNull()
    new |= timed if since is None else timed & (F.col("created_at") > F.lit(since))
    raw = stage_table(raw.where(new).dropDuplicates(["post_id"]).drop("bad_times"), "load-news")
    fresh = raw.where("created_at is not null")
    if oldest is not None:
        last = fresh.orderBy("created_at", "post_id").limit(oldest).agg(F.max("created_at")).first()[0]
        fresh = fresh.where(F.col("created_at") <= F.lit(last))
    seen = known.where(F.col("stream_id").startswith(MALFORMED_STREAM)).select(F.col("cursor").alias("post_id"))
    malformed = stage_table(raw.where("created_at is null").join(seen, "post_id", "left_anti"), "load-malformed")
    posts = fresh.unionByName(malformed).orderBy(F.col("created_at").asc_nulls_last(), "post_id")
    posts = posts.withColumn("created_at", F.coalesce(iso_z("created_at"), "published"))
    write_raw_posts(posts.select(*RAW_POST.fieldNames()), topic)
    passed = malformed.select(
        F.lit("news").alias("source"),
        F.concat(F.lit(MALFORMED_STREAM), "post_id").alias("stream_id"),
        F.col("post_id").alias("cursor"),
    )
    write_cursors(news_cursor(fresh, NEWS_STREAM).unionByName(passed), cursors, at)
