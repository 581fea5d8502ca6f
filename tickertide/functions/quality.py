"""Quality flags of an enriched post."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickertide.functions.text import strip


def quality_flags(tickers: Column | str, text: Column | str) -> Column:
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    return F.array_compact(
        F.array(
            F.when(F.size(tickers) == 0, F.lit("no_ticker")),
            F.when(blank, F.lit("empty_text")),
        )
    )
