"""Posts, payloads and mentions derived from the given tables, for both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickertide.operators.scoring import enrich
from tickertide.schema import STANCE_LABELS
from tickertide.session import pin_utc, spread

AS_OF = "2024-01-02T00:00:00"
MIDNIGHT = 1_704_067_200
ALLOW = (
    "ED NT WH BLE THRE EA THTH ING SH THAN THND ANEA ERST CH EREN THER THIN THLY THST "
    "ONON THED THOU THOR DES"
).split()


_LABELS = ", ".join(f"'{label}'" for label in STANCE_LABELS)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(pin_utc(spark).read.parquet(f"{sf}/documents.parquet"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf}/events.parquet")


def _of64(expression: Column, scale: int = 64) -> Column:
    return expression.cast("double") / scale


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Raw posts plus the label maps a scorer would return."""
    return documents(spark, sf).selectExpr(
        "doc_id",
        "if(doc_id % 3 = 0, 'news', 'reddit') AS source",
        "concat('p', doc_id) AS post_id",
        f"timestamp_seconds({MIDNIGHT} + doc_id * 7919 % 86400) AS created_at",
        "if(doc_id % 11 = 0, null, concat('u', doc_id % 17)) AS author",
        "text",
        "if(doc_id % 5 = 0, concat(' HTTP://Ex.org/', doc_id % 50, ' '), null) AS url",
        """map('lang', cast(lang AS variant), 'even', cast(doc_id % 2 = 0 AS variant),
               'place', to_variant_object(named_struct('row', doc_id, 'share', doc_id % 64 / 64D, 'path', array('a', lang)))
        ) AS meta""",
        f"""named_struct(
            'finance', map('Positive', doc_id * 7 % 33 / 64D, 'NEGATIVE', doc_id * 11 % 31 / 64D,
                           'neutral', 1 - doc_id * 7 % 33 / 64D - doc_id * 11 % 31 / 64D),
            'emotion', map_filter(map('Joy', doc_id % 9 / 16D, 'optimism', doc_id % 7 / 16D,
                                      'sadness', doc_id % 5 / 16D, 'anger', doc_id % 4 / 16D), (k, v) -> v > 0),
            'stance', map(element_at(array({_LABELS}), cast(doc_id * 5 % 6 + 1 AS int)), doc_id % 65 / 64D)
        ) AS scores""",
    )


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.timestamp_seconds(F.lit(MIDNIGHT + 86400))
    return enrich(posts(spark, sf), ALLOW, stamp)


def stance_map() -> Column:
    """Several labels per post, with ties."""
    pairs = []
    for i, label in enumerate(STANCE_LABELS):
        pairs += [F.lit(label.title()), _of64(F.col("doc_id") * (i + 3) % 9, 16)]
    return F.create_map(*pairs)


def event_posts(df: DataFrame) -> DataFrame:
    """Events as enriched posts: one ticker each."""
    kind = F.upper("event_type")
    return df.select(
        F.when(F.col("event_id") % 3 == 0, "news").otherwise("reddit").alias("source"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("post_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("user_id").cast("string").alias("author"),
        F.array(kind).alias("tickers"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 1000)).alias("finbert_score"),
        F.when(F.col("value") >= 100, "bullish").otherwise("neutral").alias("stance_label"),
        F.lit(0.5).alias("conviction"),
        F.create_map(F.lit("joy"), F.lit(0.25)).alias("emotions"),
        F.lit(1.0).alias("source_weight"),
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("dedup_key"),
    )


def news_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One response per document; some fields missing, blank or padded."""
    d = F.col("doc_id")
    published = F.date_format(
        F.timestamp_seconds(F.lit(MIDNIGHT) + d * 7919 % 86400).cast("timestamp_ntz"),
        "yyyy-MM-dd'T'HH:mm:ss",
    )
    article = F.struct(
        F.struct(F.concat(F.lit(" wire"), (d % 4).cast("string")).alias("name")).alias("source"),
        F.when(d % 11 == 0, "").otherwise(F.concat(F.lit("u"), (d % 17).cast("string"))).alias("author"),
        F.when(d % 13 == 0, "  ").otherwise(F.concat(F.lit("\tTitle "), d.cast("string"), F.lit("\n"))).alias("title"),
        F.when(d % 6 != 0, F.col("text")).alias("description"),
        F.when(d % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("http://n/"), d.cast("string"), F.lit(" "))).alias("url"),
        F.when(d % 10 == 0, F.lit(None))
        .when(d % 4 == 1, F.concat(published, F.lit("+02:00")))
        .when(d % 4 == 2, published)
        .otherwise(F.concat(published, F.lit("Z")))
        .alias("publishedAt"),
        F.when(d % 7 == 0, F.concat(F.lit(" "), "lang")).alias("content"),
    )
    return documents(spark, sf).select(
        F.concat(F.lit(" q"), (d % 3).cast("string")).alias("query"), F.array(article).alias("articles")
    )


def social_items(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as listing items."""
    c, t = F.col("conv_id"), F.col("turn")
    place = F.concat_ws("_", c.cast("string"), t.cast("string"))
    turns = spread(pin_utc(spark).read.parquet(f"{sf}/conversations.parquet"))
    return turns.select(
        F.concat(F.lit("t3_"), place).alias("fullname"),
        (F.lit(MIDNIGHT) + (c * 617 + t * 31) % 86400).cast("double").alias("created_utc"),
        F.when(c % 9 != 0, F.col("role")).alias("author"),
        F.concat(F.lit(" "), "role").alias("title"),
        F.when(t % 4 != 3, F.col("text")).alias("selftext"),
        F.when(t % 2 == 0, F.concat(F.lit("http://s/"), place)).alias("url"),
        F.concat(F.lit("/r/"), place).alias("permalink"),
        c.alias("score"),
        t.alias("num_comments"),
        F.concat(F.lit(" sub"), (c % 5).cast("string")).alias("subreddit"),
    )


def length_scorers():
    """A stand-in model: every probability follows from the length of the text.

    The factory is nested so that it travels to the workers by value.
    """

    def make():
        def finance(texts):
            return [{"Positive": len(t) % 33 / 64, "Negative": len(t) % 31 / 64} for t in texts]

        def emotion(texts):
            return [{"joy": len(t) % 9 / 16} if len(t) % 2 else {} for t in texts]

        def stance(texts):
            return [{"bullish": len(t) % 17 / 16, "meme": len(t) % 5 / 16} for t in texts]

        return finance, emotion, stance

    return make
