"""Split rows into valid ones (defaults filled in) and a quarantine with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickertide.schema import ENRICHED_POST, FLAGS, RAW_POST

_EMPTY_META = "cast(map() as map<string,variant>)"
_EMPTY_SCORES = "cast(map() as map<string,double>)"


def _missing(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.lit(f"{name} missing"))


def _outside(name: str, low: float | None, high: float | None) -> Column:
    col = F.col(name)
    bad = F.isnan(col)
    if low is not None:
        bad = bad | (col < low)
    if high is not None:
        bad = bad | (col > high)
    return F.when(bad, F.lit(f"{name} out of range"))


def _malformed(df: DataFrame) -> list[Column]:
    """A reason for each time that a decoder could not parse (``bad_times``)."""
    if "bad_times" not in df.columns:
        return []
    return [F.when(F.size("bad_times") > 0, F.concat(F.array_join("bad_times", ", "), F.lit(" malformed")))]


def _split(df: DataFrame, reasons: list[Column]) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("errors", F.array_compact(F.array(*reasons)))
    good = checked.filter(F.size("errors") == 0).drop("errors")
    return good, checked.filter(F.size("errors") > 0)


def validate_raw(df: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw posts: source, post_id and a text of at least one character are required.

    An absent time becomes ``now``; a time that is there but malformed is an error.
    """
    reasons = [
        _missing("source"),
        _missing("post_id"),
        _missing("text"),
        F.when(F.length("text") < 1, F.lit("text empty")),
        *_malformed(df),
    ]
    good, bad = _split(df, reasons)
    good = good.withColumns(
        {
            "created_at": F.coalesce("created_at", now if now is not None else F.current_timestamp()),
            "meta": F.coalesce("meta", F.expr(_EMPTY_META)),
        }
    ).select(*RAW_POST.fieldNames())
    return good, bad


def validate_enriched(df: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Enriched posts: range and flag checks, defaults for what the message left out."""
    reasons = [
        _missing("source"),
        _missing("post_id"),
        _missing("created_at"),
        _missing("text"),
        _outside("finbert_score", -1.0, 1.0),
        _outside("stance_confidence", 0.0, 1.0),
        _outside("conviction", 0.0, 1.0),
        _outside("confidence", 0.0, 1.0),
        _outside("source_weight", 0.0, None),
        F.when(~F.forall("flags", lambda f: f.isin(FLAGS)), F.lit("flags unknown")),
        *_malformed(df),
    ]
    good, bad = _split(df, reasons)
    defaults = {
        "meta": F.expr(_EMPTY_META),
        "tickers": F.expr("cast(array() as array<string>)"),
        "finbert_pos": F.lit(0.0),
        "finbert_neg": F.lit(0.0),
        "finbert_neutral": F.lit(0.0),
        "finbert_score": F.lit(0.0),
        "emotions": F.expr(_EMPTY_SCORES),
        "stance_label": F.lit("neutral"),
        "stance_confidence": F.lit(0.0),
        "stance_probs": F.expr(_EMPTY_SCORES),
        "conviction": F.lit(0.0),
        "source_weight": F.lit(1.0),
        "dedup_key": F.lit(""),
        "confidence": F.lit(0.5),
        "flags": F.expr("cast(array() as array<string>)"),
        "enriched_at": now if now is not None else F.current_timestamp(),
    }
    good = good.withColumns({name: F.coalesce(name, value) for name, value in defaults.items()})
    return good.select(*ENRICHED_POST.fieldNames()), bad


def has_ticker(tickers: Column | str = "tickers") -> Column:
    return F.size(tickers) > 0
