"""Record layouts: raw post, enriched post, rollup row, cursor row, payloads."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
STANCE_LABELS = ["bullish", "bearish", "news", "question", "meme", "neutral"]
FLAGS = [
    "low_confidence",
    "no_ticker",
    "non_english",
    "neutral",
    "low_signal",
    "empty_text",
    "duplicate",
]
RAW_TOPIC = "raw.posts"
ENRICHED_TOPIC = "enriched.posts"

# Values of any JSON type, nested ones too.
_ANY = T.MapType(T.StringType(), T.VariantType())
_SCORES = T.MapType(T.StringType(), T.DoubleType())

RAW_POST = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("post_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("author", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("meta", _ANY),
    ]
)

SCORES = T.StructType(
    [
        T.StructField("finance", _SCORES),
        T.StructField("emotion", _SCORES),
        T.StructField("stance", _SCORES),
    ]
)

ENRICHED_POST = T.StructType(
    RAW_POST.fields
    + [
        T.StructField("tickers", T.ArrayType(T.StringType())),
        T.StructField("language", T.StringType()),
        T.StructField("finbert_pos", T.DoubleType()),
        T.StructField("finbert_neg", T.DoubleType()),
        T.StructField("finbert_neutral", T.DoubleType()),
        T.StructField("finbert_score", T.DoubleType()),
        T.StructField("emotions", _SCORES),
        T.StructField("stance_label", T.StringType()),
        T.StructField("stance_confidence", T.DoubleType()),
        T.StructField("stance_probs", _SCORES),
        T.StructField("conviction", T.DoubleType()),
        T.StructField("source_weight", T.DoubleType()),
        T.StructField("dedup_key", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("enriched_at", T.TimestampType()),
    ]
)

# The stored projection of an enriched post.
ENRICHED_STORED = [
    "source",
    "post_id",
    "created_at",
    "tickers",
    "finbert_score",
    "stance_label",
    "conviction",
    "emotions",
    "source_weight",
]

# Additive measures of a rollup row; unique_authors is counted apart.
MEASURES = [
    "mention_count",
    "weighted_mentions",
    "news_count",
    "reddit_count",
    "sentiment_sum",
    "sentiment_count",
    "bullish_count",
    "bearish_count",
    "neutral_count",
    "conviction_sum",
]

ROLLUP = T.StructType(
    [
        T.StructField("bucket_start", T.TimestampType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("mention_count", T.LongType()),
        T.StructField("weighted_mentions", T.DoubleType()),
        T.StructField("unique_authors", T.LongType()),
        T.StructField("news_count", T.LongType()),
        T.StructField("reddit_count", T.LongType()),
        T.StructField("sentiment_sum", T.DoubleType()),
        T.StructField("sentiment_count", T.LongType()),
        T.StructField("bullish_count", T.LongType()),
        T.StructField("bearish_count", T.LongType()),
        T.StructField("neutral_count", T.LongType()),
        T.StructField("conviction_sum", T.DoubleType()),
        T.StructField("emotion_sums", _SCORES),
    ]
)

AUTHORS = T.StructType(
    [
        T.StructField("bucket_start", T.TimestampType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("author_key", T.StringType()),
    ]
)

CURSORS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("stream_id", T.StringType()),
        T.StructField("cursor", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

SOCIAL_ITEM = T.StructType(
    [
        T.StructField("fullname", T.StringType()),
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("author", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("permalink", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("num_comments", T.LongType()),
        T.StructField("subreddit", T.StringType()),
    ]
)

NEWS_RESPONSE = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField(
            "articles",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "source", T.StructType([T.StructField("name", T.StringType())])
                        ),
                        T.StructField("author", T.StringType()),
                        T.StructField("title", T.StringType()),
                        T.StructField("description", T.StringType()),
                        T.StructField("url", T.StringType()),
                        T.StructField("publishedAt", T.StringType()),
                        T.StructField("content", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
