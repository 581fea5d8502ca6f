"""Trending and movers rankings over the rollup, in their two dialects.

The ``api`` and ``web`` dialects look alike but differ in baseline period, base
rate, defaults, score and in where the cross-source filter sits.
Every query takes ``as_of``; recent windows have no upper bound, and a bucket that
is only partly inside the window is left out whole.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickertide.functions.time import at_or_after, between, utc
from tickertide.sources.tables import read_rollup_deltas

# Emotions weighed, score weights and default ratios of each dialect.
EMOTIONS = ["joy", "optimism", "fear", "sadness"]
API_VOLUME, API_SPIKE, API_SENTIMENT, API_TILT, API_CONVICTION, API_CROSS = 0.45, 0.35, 0.10, 0.10, 0.10, 0.05
WEB_SPIKE, WEB_BULLISH, WEB_CONVICTION, WEB_SENTIMENT = 0.45, 0.25, 0.20, 0.10
API_NO_DIRECTION, WEB_NO_DIRECTION = 0.5, 0.0
MIN_WINDOW_HOURS = 0.01

_API_SUMS = {
    "mentions": "mention_count",
    "weighted_mentions": "weighted_mentions",
    "news_mentions": "news_count",
    "reddit_mentions": "reddit_count",
    "sent_sum": "sentiment_sum",
    "sent_cnt": "sentiment_count",
    "bull": "bullish_count",
    "bear": "bearish_count",
    "conv_sum": "conviction_sum",
}


def _ratio(top: Column, bottom: Column, default: float) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(default))


def _cross_source() -> Column:
    return (F.col("news_mentions") > 0) & (F.col("reddit_mentions") > 0)


# --- trending -----------------------------------------------------------------


def _recent_sums(rollup: DataFrame, as_of: datetime | str, minutes: int) -> DataFrame:
    start = utc(as_of) - timedelta(minutes=minutes)
    return (
        rollup.filter(at_or_after("bucket_start", start))
        .groupBy("ticker")
        .agg(
            F.sum("mention_count").alias("mentions"),
            F.sum("sentiment_sum").alias("sent_sum"),
            F.sum("sentiment_count").alias("sent_cnt"),
        )
    )


def _top_mentions(sums: DataFrame, mentions_type: str, limit: int) -> DataFrame:
    return (
        sums.select(
            "ticker",
            F.coalesce("mentions", F.lit(0)).cast(mentions_type).alias("mentions"),
            F.coalesce(
                F.try_divide(F.col("sent_sum"), F.nullif("sent_cnt", F.lit(0))), F.lit(0.0)
            ).alias("sentiment_mean"),
        )
        .orderBy(F.desc("mentions"), "ticker")
        .limit(limit)
    )


def trending_api(
    rollup: DataFrame, as_of: datetime | str, minutes: int = 60, limit: int = 25
) -> DataFrame:
    """Most mentioned tickers of the last ``minutes``."""
    return _top_mentions(_recent_sums(rollup, as_of, minutes), "long", limit)


def trending_web(
    rollup: DataFrame, as_of: datetime | str, minutes: int = 60, limit: int = 10
) -> DataFrame:
    return _top_mentions(_recent_sums(rollup, as_of, minutes), "int", limit)


# --- movers: recent and baseline sums -----------------------------------------


def _recent_values(with_emotions: bool) -> dict[str, str]:
    """Alias to SQL of every value summed over the recent window."""
    emotions = {f"{e}_sum": f"coalesce(emotion_sums['{e}'], 0D)" for e in EMOTIONS}
    return {**_API_SUMS, **(emotions if with_emotions else {})}


def _one_scan(
    rollup: DataFrame, start: datetime, base: tuple[datetime, datetime], with_emotions: bool, deltas: bool = False
) -> DataFrame:
    """Recent and baseline sums from a single scan and a single exchange.

    ``deltas`` are summed by bucket first, so that the buckets of the baseline can be counted.
    """
    values = _recent_values(with_emotions)
    rows = rollup.filter(at_or_after("bucket_start", min(start, base[0])))
    if deltas:
        rows = rows.groupBy("ticker", "bucket_start").agg(
            *[F.expr(f"sum({sql}) AS _{alias}") for alias, sql in values.items()],
            F.sum("mention_count").alias("mention_count"),
        )
        values = {alias: f"_{alias}" for alias in values}
    recent = at_or_after("bucket_start", start)
    earlier = between("bucket_start", *base)
    return (
        rows.filter(recent | earlier)
        .withColumns({"_recent": recent, "_earlier": earlier})
        .groupBy("ticker")
        .agg(
            *[F.expr(f"sum({sql}) FILTER (WHERE _recent) AS {alias}") for alias, sql in values.items()],
            F.expr("coalesce(sum(mention_count) FILTER (WHERE _earlier), 0) AS base_mentions"),
            F.expr("count_if(_earlier) AS base_buckets"),
            F.expr("count_if(_recent) AS _rows"),
        )
        .filter("_rows > 0")
        .drop("_rows")
    )


def _two_scans(
    rollup: DataFrame, start: datetime, base: tuple[datetime, datetime], with_emotions: bool
) -> DataFrame:
    """The same sums as a left join of two aggregates on the ticker."""
    recent = (
        rollup.filter(at_or_after("bucket_start", start))
        .groupBy("ticker")
        .agg(*[F.expr(f"sum({v}) AS {a}") for a, v in _recent_values(with_emotions).items()])
    )
    baseline = (
        rollup.filter(between("bucket_start", *base))
        .groupBy("ticker")
        .agg(F.sum("mention_count").alias("base_mentions"), F.count("*").alias("base_buckets"))
    )
    return (
        recent.join(baseline, "ticker", "left")
        .withColumn("base_mentions", F.coalesce("base_mentions", F.lit(0)))
        .withColumn("base_buckets", F.coalesce("base_buckets", F.lit(0)))
    )


def _sums(rollup, start, base, with_emotions, single_scan, deltas=False):
    if not single_scan:
        return _two_scans(rollup, start, base, with_emotions)
    return _one_scan(rollup, start, base, with_emotions, deltas and with_emotions)


# --- movers -------------------------------------------------------------------


def movers_api(
    rollup: DataFrame,
    as_of: datetime | str,
    window_minutes: int = 60,
    baseline_hours: int = 24,
    limit: int = 25,
    require_cross_source: bool = False,
    single_scan: bool = True,
    deltas: bool = False,
) -> DataFrame:
    """Tickers ranked by score against their baseline ``[as_of - hours, window start)``.

    The base rate is per non-empty bucket, and the cross-source filter applies
    to the ranked rows, after the limit. ``deltas``: several rows may share a bucket.
    """
    now = utc(as_of)
    start = now - timedelta(minutes=window_minutes)
    base = (now - timedelta(hours=baseline_hours), start)
    buckets = float(max(1, window_minutes // 5))
    sums = _sums(rollup, start, base, True, single_scan, deltas)

    mentions = F.col("mentions")
    pleasant = F.col("optimism_sum") + F.col("joy_sum")
    unpleasant = F.col("fear_sum") + F.col("sadness_sum")
    measured = (
        sums.filter(mentions > 0)
        .withColumn("base_rate_5m", _ratio(F.col("base_mentions"), F.col("base_buckets"), 0.0))
        .withColumns(
            {
                "spike_ratio": mentions.cast("double") / (F.col("base_rate_5m") * buckets + 1.0),
                "sentiment_mean": _ratio(F.col("sent_sum"), F.col("sent_cnt"), 0.0),
                "conviction_mean": _ratio(F.col("conv_sum"), mentions, 0.0),
                "bullish_ratio": _ratio(F.col("bull"), F.col("bull") + F.col("bear"), API_NO_DIRECTION),
                "emotion_tilt": _ratio(pleasant - unpleasant, mentions, 0.0),
                "cross_source": _cross_source(),
            }
        )
    )
    volume = F.ln(1 + mentions.cast("double"))
    score = (
        API_VOLUME * volume
        + API_SPIKE * volume * F.col("spike_ratio")
        + API_SENTIMENT * F.greatest(F.lit(0.0), F.col("sentiment_mean"))
        + API_TILT * F.col("emotion_tilt")
        + API_CONVICTION * F.col("conviction_mean")
        + API_CROSS * F.col("cross_source").cast("int")
    )
    top = measured.withColumn("score", score).orderBy(F.desc("score"), "ticker").limit(limit)
    if require_cross_source:
        top = top.filter("cross_source")
    return top.select(
        "ticker",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("score",)],
        F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"),
        *[
            F.coalesce(c, F.lit(0.0)).alias(c)
            for c in (
                "weighted_mentions",
                "spike_ratio",
                "base_rate_5m",
                "sentiment_mean",
                "bullish_ratio",
                "conviction_mean",
                "emotion_tilt",
            )
        ],
        *[
            F.coalesce(c, F.lit(0)).cast("long").alias(c)
            for c in ("news_mentions", "reddit_mentions")
        ],
        "cross_source",
    )


def movers_web(
    rollup: DataFrame,
    as_of: datetime | str,
    window_minutes: int = 60,
    baseline_hours: int = 6,
    limit: int = 10,
    require_cross_source: bool = False,
    single_scan: bool = True,
) -> DataFrame:
    """Tickers ranked against the ``baseline_hours`` before the window.

    The baseline is per clock hour, and the cross-source filter applies before
    the limit.
    """
    start = utc(as_of) - timedelta(minutes=window_minutes)
    base = (start - timedelta(hours=baseline_hours), start)
    sums = _sums(rollup, start, base, False, single_scan)

    def total(name: str) -> Column:
        return F.col(name).cast("double")

    per_hour = F.col("base_mentions").cast("double") / float(max(baseline_hours, 1))
    window_hours = max(window_minutes / 60.0, MIN_WINDOW_HOURS)
    scored = (
        sums.withColumn("baseline_per_hour", F.coalesce(per_hour, F.lit(0.0)))
        .select(
            "ticker",
            total("mentions").alias("mentions"),
            total("news_mentions").alias("news_mentions"),
            total("reddit_mentions").alias("reddit_mentions"),
            _ratio(total("sent_sum"), total("sent_cnt"), 0.0).alias("sentiment_mean"),
            _ratio(total("bull"), total("bull") + total("bear"), WEB_NO_DIRECTION).alias("bullish_ratio"),
            _ratio(total("conv_sum"), total("sent_cnt"), 0.0).alias("conviction_mean"),
            "baseline_per_hour",
            ((total("mentions") / window_hours) / (F.col("baseline_per_hour") + 1.0)).alias("spike_ratio"),
            _cross_source().alias("cross_source"),
        )
    )
    if require_cross_source:
        scored = scored.filter("cross_source")
    order = (
        WEB_SPIKE * F.col("spike_ratio")
        + WEB_BULLISH * F.col("bullish_ratio")
        + WEB_CONVICTION * F.col("conviction_mean")
        + WEB_SENTIMENT * F.col("sentiment_mean")
    )
    return scored.orderBy(order.desc(), F.asc("ticker")).limit(limit)


# --- over the stored deltas: every measure is a sum, so they are added by ticker at once ---


def trending_stored(
    spark: SparkSession, root: str, as_of: datetime | str, minutes: int = 60, limit: int = 25
) -> DataFrame:
    """``trending_api`` over the stored rollup; opens the days of the window only."""
    rows = read_rollup_deltas(spark, root, utc(as_of) - timedelta(minutes=minutes))
    return trending_api(rows, as_of, minutes, limit)


def movers_api_stored(
    spark: SparkSession, root: str, as_of: datetime | str, window_minutes: int = 60, baseline_hours: int = 24, **options
) -> DataFrame:
    """``movers_api`` over the stored rollup; opens the days of the baseline on only."""
    since = utc(as_of) - max(timedelta(minutes=window_minutes), timedelta(hours=baseline_hours))
    rows = read_rollup_deltas(spark, root, since)
    return movers_api(rows, as_of, window_minutes, baseline_hours, deltas=True, **options)


def movers_web_stored(
    spark: SparkSession, root: str, as_of: datetime | str, window_minutes: int = 60, baseline_hours: int = 6, **options
) -> DataFrame:
    """``movers_web`` over the stored rollup."""
    since = utc(as_of) - timedelta(minutes=window_minutes, hours=baseline_hours)
    return movers_web(read_rollup_deltas(spark, root, since), as_of, window_minutes, baseline_hours, **options)
