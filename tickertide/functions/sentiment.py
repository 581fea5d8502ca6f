"""Columns derived from raw label → probability maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickertide.schema import STANCE_LABELS

# Weights of conviction and of the news source.
STANCE_WEIGHT, SENTIMENT_WEIGHT = 0.65, 0.35
NEWS_WEIGHT, OTHER_WEIGHT = 1.2, 1.0


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def _with(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def _last_wins(entries: Column) -> Column:
    """Array of (key, value) structs to a map; of equal keys the last value counts."""
    def is_last(entry: Column, at: Column) -> Column:
        later = F.slice(entries, at + 2, F.size(entries))
        return ~F.exists(later, lambda x: x["key"] == entry["key"])

    return F.map_from_entries(F.filter(entries, is_last))


def lower_keys(probs: Column | str) -> Column:
    """The map with lower-case labels; of labels equal up to case the last one counts."""
    lowered = F.transform(
        F.map_entries(probs), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    return _with(lowered, _last_wins)


def emotion_map(pairs: Column | str) -> Column:
    """Array of (label, probability) structs, whatever their fields are called, to a map with
    lower-case labels; of labels equal up to case the last one counts."""
    column = pairs if isinstance(pairs, Column) else F.col(pairs)
    named = column.cast("array<struct<key:string,value:double>>")
    lowered = F.transform(
        named, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    return _with(lowered, _last_wins)


def sentiment_from_probs(probs: Column | str) -> Column:
    """Struct of pos, neg, neutral and score = pos - neg within [-1, 1]."""
    def body(lowered: Column) -> Column:
        def prob(label: str) -> Column:
            return F.coalesce(F.element_at(lowered, F.lit(label)), F.lit(0.0))

        return F.struct(
            prob("positive").alias("pos"),
            prob("negative").alias("neg"),
            prob("neutral").alias("neutral"),
            _clamp(prob("positive") - prob("negative"), -1.0, 1.0).alias("score"),
        )

    return _with(lower_keys(probs), body)


def stance_from_probs(probs: Column | str, labels: list[str] = STANCE_LABELS) -> Column:
    """Struct of label, confidence and probs; ties go to the earlier label of the list."""
    order = F.array(*[F.lit(x) for x in labels])

    def candidate(entry: Column) -> Column:
        place = F.array_position(order, entry["key"])
        rank = F.when(place == 0, F.lit(len(labels) + 1)).otherwise(place)
        return F.struct(entry["value"].alias("p"), (-rank).alias("r"), entry["key"].alias("label"))

    def body(lowered: Column) -> Column:
        top = F.array_max(F.transform(F.map_entries(lowered), candidate))
        return F.struct(
            F.coalesce(top["label"], F.lit("neutral")).alias("label"),
            F.coalesce(top["p"], F.lit(0.0)).alias("confidence"),
            lowered.alias("probs"),
        )

    return _with(lower_keys(probs), body)


def conviction(stance: Column, confidence: Column, score: Column) -> Column:
    directional = F.when(stance.isin("bullish", "bearish"), confidence).otherwise(F.lit(0.0))
    return _clamp(STANCE_WEIGHT * directional + SENTIMENT_WEIGHT * F.abs(score), 0.0, 1.0)


def source_weight(source: Column | str) -> Column:
    column = source if isinstance(source, Column) else F.col(source)
    return F.when(column == "news", F.lit(NEWS_WEIGHT)).otherwise(F.lit(OTHER_WEIGHT))
