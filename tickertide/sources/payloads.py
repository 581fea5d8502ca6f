"""Landed connector payloads to raw posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickertide.functions.text import strip
from tickertide.functions.time import bad_times, parse_iso_utc
from tickertide.schema import NEWS_RESPONSE, RAW_POST, SOCIAL_ITEM

# Fixed value: permalinks arrive without the host.
PERMALINK_PREFIX = "https://www.reddit.com"


def read_social_items(spark: SparkSession, path: str) -> DataFrame:
    """Listing items landed as JSON lines."""
    return spark.read.schema(SOCIAL_ITEM).json(path)


def read_news_responses(spark: SparkSession, path: str) -> DataFrame:
    """Search responses landed as JSON lines, each with its ``query``."""
    return spark.read.schema(NEWS_RESPONSE).json(path)


def _trimmed(name: str) -> Column:
    return strip(F.coalesce(name, F.lit("")))


def _or_null(text: Column | str) -> Column:
    return F.nullif(text, F.lit(""))


def _meta(**values: Column) -> Column:
    """A map to values that keep their JSON type."""
    pairs = ((F.lit(name), value.cast("variant")) for name, value in values.items())
    return F.create_map(*(part for pair in pairs for part in pair))


def social_to_raw(items: DataFrame) -> DataFrame:
    body = F.concat("title", F.lit("\n\n"), F.coalesce("selftext", F.lit("")))
    return items.select(
        F.lit("reddit").alias("source"),
        F.col("fullname").alias("post_id"),
        F.timestamp_micros(F.round(F.col("created_utc") * 1_000_000).cast("long")).alias("created_at"),
        _or_null("author").alias("author"),
        strip(body).alias("text"),
        F.col("url"),
        _meta(
            subreddit=strip("subreddit"),
            permalink=F.concat(F.lit(PERMALINK_PREFIX), "permalink"),
            score=F.col("score"),
            num_comments=F.col("num_comments"),
        ).alias("meta"),
    ).select(*RAW_POST.fieldNames())


def news_post_id(url: Column | str, title: Column | str, published: Column | str) -> Column:
    """Stable id from the URL (the title when there is none) and the publication time."""
    link = url if isinstance(url, Column) else F.col(url)
    stable = F.when(F.coalesce(link, F.lit("")) != "", link).otherwise(
        F.concat(F.lit("title:"), F.coalesce(title, F.lit("")))
    )
    digest = F.sha2(F.concat(stable, F.lit("|"), published), 256)
    return F.concat(F.lit("news_"), F.substring(digest, 1, 24))


def news_articles(responses: DataFrame) -> DataFrame:
    """One row per article with a publication time, fields trimmed."""
    articles = responses.select(strip("query").alias("query"), F.explode("articles").alias("a"))
    return articles.filter(F.coalesce("a.publishedAt", F.lit("")) != "").select(
        "query",
        _trimmed("a.url").alias("url"),
        _trimmed("a.title").alias("title"),
        _trimmed("a.description").alias("description"),
        _trimmed("a.content").alias("content"),
        _trimmed("a.source.name").alias("source_name"),
        F.col("a.author").alias("author"),
        F.col("a.publishedAt").alias("published"),
    )


def news_to_raw(responses: DataFrame, published: bool = False) -> DataFrame:
    """Raw posts, with ``bad_times`` for a publication time that can't be parsed.

    ``published`` adds the text of that time.
    """
    parts = [_or_null(c) for c in ("title", "description", "content")]
    return (
        news_articles(responses)
        .select(
            F.lit("news").alias("source"),
            news_post_id("url", "title", "published").alias("post_id"),
            parse_iso_utc("published").alias("created_at"),
            F.col("published"),
            _or_null("author").alias("author"),
            F.concat_ws("\n\n", *parts).alias("text"),
            _or_null("url").alias("url"),
            _meta(query=F.col("query"), source_name=F.col("source_name")).alias("meta"),
        )
        .select(
            *RAW_POST.fieldNames(),
            bad_times({"created_at": (F.col("published"), F.col("created_at"))}),
            *(["published"] if published else []),
        )
    )
