"""Five-minute ticker rollup: mentions, additive sums, distinct authors, emotion sums."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tickertide.functions.text import author_key
from tickertide.functions.time import BUCKET, floor_5m
from tickertide.operators.authors import count_bitmaps, widen_bitmaps
from tickertide.schema import MEASURES, ROLLUP

_NO_SUMS = "cast(map() as map<string,double>)"
# A fact is labelled by the author it counts or the emotion it adds to.
_AUTHOR, _EMOTION = "@", "#"
_SUMS = ("weighted_mentions", "sentiment_sum", "conviction_sum")


def explode_mentions(posts: DataFrame, *extra: str) -> DataFrame:
    """One row per (post, ticker), holding only what the rollup reads (and ``extra``).

    Posts without a ticker vanish in the explode.  No filter says so beforehand,
    and the array is wrapped so that none is inferred: pushed down, it would
    evaluate the ticker extraction a second time.
    """
    return posts.select(
        "source",
        "post_id",
        "created_at",
        "author",
        F.explode(F.array_compact("tickers")).alias("ticker"),
        "finbert_score",
        "stance_label",
        "conviction",
        "emotions",
        "source_weight",
        *extra,
    )


# The additive measures of a single mention.
_PER_MENTION = {
    "mention_count": "1L",
    "weighted_mentions": "source_weight",
    "news_count": "if(source = 'news', 1L, 0L)",
    "reddit_count": "if(source = 'reddit', 1L, 0L)",
    "sentiment_sum": "finbert_score",
    "sentiment_count": "1L",
    "bullish_count": "if(stance_label = 'bullish', 1L, 0L)",
    "bearish_count": "if(stance_label = 'bearish', 1L, 0L)",
    "neutral_count": "if(stance_label IN ('bullish', 'bearish'), 0L, 1L)",
    "conviction_sum": "conviction",
}


def _facts(
    rows: DataFrame, keys: list[str], values: dict[str, str], label: str, emotions: str
) -> DataFrame:
    """Turn each row into one measure fact and one fact per emotion, and sum them.

    ``values`` holds the SQL of every measure, ``label`` that of the measure
    fact's label.  Summing by (keys, label) collapses hot groups on the map side,
    so neither an author set nor a pile of maps is ever gathered per group.
    """
    own = ", ".join(f"'{m}', {sql}" for m, sql in values.items())
    none = ", ".join(f"'{m}', {'0D' if m in _SUMS else '0L'}" for m in values)
    facts = rows.selectExpr(
        *keys,
        f"""inline(concat(
            array(named_struct('label', {label}, 'amount', 0D, {own})),
            transform(map_entries(coalesce({emotions}, {_NO_SUMS})), e -> named_struct(
                'label', concat('{_EMOTION}', e.key), 'amount', coalesce(e.value, 0D), {none}))))""",
    )
    return facts.groupBy(*keys, "label").agg(*_sum_exprs(["amount", *values]))


def _sum_exprs(names: Iterable[str]) -> list[Column]:
    return [F.expr(f"sum({name}) AS {name}") for name in names]


# The emotion map of one group; it holds as many entries as there are labels.
_EMOTION_MAP = f"""map_from_entries(sort_array(collect_list(
    if(startswith(label, '{_EMOTION}'), named_struct('label', substr(label, 2), 'amount', amount), null)
))) AS emotion_sums"""


def rollup_5m(
    posts: DataFrame,
    known_authors: DataFrame | None = None,
    windowed: bool = False,
    new_authors: DataFrame | None = None,
) -> DataFrame:
    """Roll enriched posts up by (bucket, ticker).

    ``known_authors`` (bucket_start, ticker, author_key) are not counted again,
    which makes ``unique_authors`` additive over successive calls.  ``windowed``
    groups by Spark's event-time window, as a watermarked stream needs.

    ``new_authors`` are the distinct authors to count, where a caller has written them already
    (``mention_authors`` of these posts, without the known ones). The posts are read twice then, and no row
    carries an author beside the measures.
    """
    if new_authors is not None:
        return _with_authors(posts, new_authors)
    keys = ["bucket" if windowed else "bucket_start", "ticker"]
    bucket = F.window("created_at", BUCKET) if windowed else floor_5m("created_at")
    # Both are computed once per post, before it turns into mentions.
    posts = posts.withColumn(keys[0], bucket).withColumn("_author", author_key("source", "author"))
    mentions = explode_mentions(posts, keys[0], "_author")
    facts = _facts(mentions, keys, _PER_MENTION, f"concat('{_AUTHOR}', _author)", "emotions")
    is_new = F.coalesce(F.col("label").startswith(_AUTHOR), F.lit(False))
    if known_authors is not None:
        seen = known_authors.select(
            *keys, F.concat(F.lit(_AUTHOR), "author_key").alias("label"), F.lit(True).alias("_seen")
        )
        # The facts are partitioned by these very columns already.
        facts = facts.join(seen, [*keys, "label"], "left")
        is_new = is_new & F.col("_seen").isNull()
    rolled = facts.groupBy(*keys).agg(
        *_sum_exprs(MEASURES), F.count_if(is_new).alias("unique_authors"), F.expr(_EMOTION_MAP)
    )
    if windowed:
        rolled = rolled.withColumn("bucket_start", F.col("bucket.start"))
    return rolled.select(*ROLLUP.fieldNames())


def _with_authors(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """The rollup of stored posts: measures, emotions and authors are summed apart, then put together.

    The posts are read for the measures and for the emotions; no row is made for a fact before it is summed.
    """
    keys = ["bucket_start", "ticker"]
    mentions = explode_mentions(posts.withColumn("bucket_start", floor_5m("created_at")), "bucket_start")
    measures = mentions.groupBy(*keys).agg(*[F.expr(f"sum({sql}) AS {name}") for name, sql in _PER_MENTION.items()])
    emotions = mentions.select(*keys, F.explode("emotions").alias("label", "amount")).groupBy(*keys, "label")
    emotions = emotions.agg(F.sum(F.coalesce("amount", F.lit(0.0))).alias("amount"))
    none = [F.lit(0.0 if name in _SUMS else 0).alias(name) for name in MEASURES]
    counts = authors.where("author_key IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("unique_authors"))
    facts = (
        measures.unionByName(
            emotions.select(*keys, F.concat(F.lit(_EMOTION), "label").alias("label"), "amount", *none),
            allowMissingColumns=True,
        )
        .unionByName(counts, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(*_sum_exprs(MEASURES), F.coalesce(F.sum("unique_authors"), F.lit(0)).alias("unique_authors"), F.expr(_EMOTION_MAP))
    )
    return facts.where("mention_count > 0").select(*ROLLUP.fieldNames())


def mention_authors(posts: DataFrame) -> DataFrame:
    """The distinct (bucket_start, ticker, author_key) of the posts."""
    return (
        posts.filter(F.col("author") != "")
        .select(
            floor_5m("created_at").alias("bucket_start"),
            F.explode(F.array_compact("tickers")).alias("ticker"),
            author_key("source", "author").alias("author_key"),
        )
        .distinct()
    )


def unique_authors(posts: DataFrame) -> DataFrame:
    """Exact distinct authors by (bucket_start, ticker), for groups that have any."""
    return mention_authors(posts).groupBy("bucket_start", "ticker").agg(
        F.count("*").alias("unique_authors")
    )


def sum_maps(df: DataFrame, keys: list[str], map_col: str, out: str | None = None) -> DataFrame:
    """Add maps up key by key over the union of their keys; no keys gives an empty map."""
    entry = F.transform(
        F.map_entries(F.coalesce(map_col, F.expr(_NO_SUMS))),
        lambda e: F.struct(e["key"].alias("label"), F.coalesce(e["value"], F.lit(0.0)).alias("amount")),
    )
    flat = df.select(*keys, F.inline_outer(entry))
    by_label = flat.groupBy(*keys, "label").agg(F.sum("amount").alias("amount"))
    entries = F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "amount")))
    return by_label.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(entries)).alias(out or map_col)
    )


def sum_rollup(rows: DataFrame, keys: list[str], with_authors: bool = False) -> DataFrame:
    """Re-sum rollup rows by ``keys``.

    Author counts add up only when the rows count disjoint author sets, as
    successive deltas do; they do not add up over buckets.
    """
    names = [*MEASURES, "unique_authors"] if with_authors else MEASURES
    facts = _facts(rows, keys, {n: n for n in names}, "cast(null AS string)", "emotion_sums")
    return facts.groupBy(*keys).agg(*_sum_exprs(names), F.expr(_EMOTION_MAP))


def rollup_to(rows: DataFrame, width: str, bitmaps: DataFrame | None = None) -> DataFrame:
    """Five-minute rows to any wider tumbling window.

    Author counts of the rows don't add up over buckets, so there are none unless
    ``bitmaps`` (see ``operators/authors.py``) are given: those of the same rows.
    """
    wide = rows.withColumn("bucket_start", F.window("bucket_start", width)["start"])
    summed = sum_rollup(wide, ["bucket_start", "ticker"])
    if bitmaps is None:
        return summed
    counts = count_bitmaps(widen_bitmaps(bitmaps, width))
    counted = summed.join(counts, ["bucket_start", "ticker"], "left")
    return counted.withColumn("unique_authors", F.coalesce("unique_authors", F.lit(0)))


def merge_rollup(target: DataFrame, delta: DataFrame) -> DataFrame:
    """Additive upsert of one rollup into another by (bucket_start, ticker).

    The delta's ``unique_authors`` must leave out authors the target knows;
    ``rollup_5m(..., known_authors=...)`` counts that way.
    """
    keys = ["bucket_start", "ticker"]
    t, d = target.alias("t"), delta.alias("d")
    added = [
        (F.coalesce(F.col(f"t.{m}"), F.lit(0)) + F.coalesce(F.col(f"d.{m}"), F.lit(0))).alias(m)
        for m in [*MEASURES, "unique_authors"]
    ]
    emotions = F.map_zip_with(
        F.coalesce("t.emotion_sums", F.expr(_NO_SUMS)),
        F.coalesce("d.emotion_sums", F.expr(_NO_SUMS)),
        lambda _, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)),
    )
    merged = t.join(d, keys, "full_outer").select(*keys, *added, emotions.alias("emotion_sums"))
    return merged.select(*ROLLUP.fieldNames())
