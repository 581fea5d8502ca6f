"""Ticker extraction, with an allowlist of checked size."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tickertide.functions.text import (
    STOP_TOKENS,
    SYMBOL_PATTERN,
    drop_stop_tokens,
    ordered_distinct,
    ticker_candidates,
)

# Allowlists up to this size become a hashed IN-set inside the plan; larger ones are
# broadcast. Neither is joined, and both give the same rows.
LITERAL_LIMIT = 20_000


def _allowed_rows(df: DataFrame, allow: DataFrame | Iterable[str]) -> DataFrame:
    """The usable symbols as a one-column frame, without anything a text cannot yield."""
    if not isinstance(allow, DataFrame):
        allow = df.sparkSession.createDataFrame([(s,) for s in allow], "symbol string")
    symbol = F.col(allow.columns[0])
    usable = symbol.rlike(SYMBOL_PATTERN) & ~symbol.isin(STOP_TOKENS)
    return allow.filter(usable).select(symbol.alias("symbol")).distinct()


def extract_tickers(
    df: DataFrame,
    text_col: str = "text",
    allow: DataFrame | Iterable[str] | None = None,
    out: str = "tickers",
    literal_limit: int = LITERAL_LIMIT,
) -> DataFrame:
    """Add the ordered distinct tickers of each text, on a batch or a stream."""
    if allow is None:
        found = ordered_distinct(drop_stop_tokens(ticker_candidates(text_col)))
        return df.withColumn(out, found)
    symbols = _symbols(df, allow)
    found = df.withColumn(out, ticker_candidates(text_col))
    keep = keep_allowed_literal if len(symbols) <= literal_limit else keep_allowed_set
    return keep(found, symbols, out)


def _symbols(df: DataFrame, allow: DataFrame | Iterable[str]) -> list[str]:
    """The usable symbols. Five letters A-Z at most: some 12 million words of 5 bytes bound it."""
    if isinstance(allow, DataFrame):
        return sorted(r.symbol for r in _allowed_rows(df, allow).collect())
    stop = set(STOP_TOKENS)
    return sorted(
        {s for s in allow if 1 <= len(s) <= 5 and s.isascii() and s.isalpha() and s.isupper()} - stop
    )


def keep_allowed_literal(df: DataFrame, symbols: list[str], column: str) -> DataFrame:
    """Filter an array column against symbols that match ``SYMBOL_PATTERN``."""
    if not symbols:
        return df.withColumn(column, F.expr("cast(array() as array<string>)"))
    # One parsed IN list is turned into a hash set by the optimizer.
    names = ",".join(f"'{s}'" for s in symbols)
    return df.withColumn(column, F.expr(f"array_distinct(filter(`{column}`, s -> s IN ({names})))"))


def keep_allowed_set(df: DataFrame, symbols: list[str], column: str) -> DataFrame:
    """The same filter for lists too large for the plan.

    The symbols are broadcast, and only the candidates cross to Python, in Arrow batches: no
    join and no shuffle, in batch and on a stream.
    """
    allowed, name = df.sparkSession.sparkContext.broadcast(symbols), uuid.uuid4().hex

    @arrow_udf("array<string>")
    def keep(candidates: pa.Array) -> pa.Array:
        known = _value_set(name, allowed)
        row = pc.list_parent_indices(candidates)
        flat = pc.list_flatten(candidates)
        hit = pc.is_in(flat, value_set=known)
        row, flat = row.filter(hit), flat.filter(hit)
        seen, rows = set(), [[] for _ in range(len(candidates))]
        for at, symbol in zip(row.to_pylist(), flat.to_pylist()):
            if (at, symbol) not in seen:
                seen.add((at, symbol))
                rows[at].append(symbol)
        return pa.array(rows, pa.list_(pa.string()))

    return df.withColumn(column, keep(F.col(column)))


_sets: dict[str, pa.Array] = {}


def _value_set(name: str, allowed) -> pa.Array:
    """The broadcast symbols as an Arrow array, built once for each worker process."""
    if name not in _sets:
        _sets.clear()
        _sets[name] = pa.array(allowed.value, pa.string())
    return _sets[name]
