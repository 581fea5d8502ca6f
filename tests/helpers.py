"""Small builders shared by the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickertide.schema import ENRICHED_POST, ROLLUP

DEFAULTS = {
    "source": "reddit",
    "author": "ann",
    "text": "t",
    "url": None,
    "meta": {},
    "tickers": ["AA"],
    "language": None,
    "finbert_pos": 0.0,
    "finbert_neg": 0.0,
    "finbert_neutral": 0.0,
    "finbert_score": 0.25,
    "emotions": {"joy": 0.5},
    "stance_label": "bullish",
    "stance_confidence": 0.5,
    "stance_probs": {},
    "conviction": 0.5,
    "source_weight": 1.0,
    "dedup_key": "k",
    "confidence": 0.5,
    "flags": [],
    "enriched_at": None,
}


def enriched(spark, rows: list[dict]) -> DataFrame:
    full = [{**DEFAULTS, "post_id": f"p{i}", **row} for i, row in enumerate(rows)]
    return spark.createDataFrame(
        [tuple(r[n] for n in ENRICHED_POST.fieldNames()) for r in full], ENRICHED_POST
    )


def rollup(spark, rows: list[dict]) -> DataFrame:
    """Rollup rows; counts that are not given follow from ``mention_count``."""
    out = []
    for row in rows:
        n = row.get("mention_count", 1)
        base = {
            "mention_count": n,
            "weighted_mentions": float(n),
            "unique_authors": n,
            "news_count": 0,
            "reddit_count": n,
            "sentiment_sum": 0.0,
            "sentiment_count": n,
            "bullish_count": 0,
            "bearish_count": 0,
            "neutral_count": n,
            "conviction_sum": 0.0,
            "emotion_sums": {},
        }
        full = {**base, **row}
        out.append(tuple(full[c] for c in ROLLUP.fieldNames()))
    return spark.createDataFrame(out, ROLLUP)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def comparable(df: DataFrame) -> DataFrame:
    """A rollup whose map is text and whose sums are rounded."""
    pairs = F.transform(
        F.array_sort(F.map_entries("emotion_sums")),
        lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 9).cast("string")),
    )
    sums = {c: F.round(c, 9) for c in ("weighted_mentions", "sentiment_sum", "conviction_sum")}
    return df.withColumns({**sums, "emotion_sums": F.array_join(pairs, ",")})
