"""Text columns: whitespace, hashing keys, ticker candidates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# The characters that count as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# Tokens that are never tickers.
STOP_TOKENS = [
    "A", "AN", "AND", "ARE", "AS", "AT",
    "BE", "BY",
    "CEO", "CFO", "COO",
    "FOR", "FROM",
    "HE", "HER", "HIS",
    "I", "IN", "IS", "IT",
    "OF", "ON", "OR", "OUR", "OUT",
    "THE", "TO",
    "US", "USA",
    "WAS", "WE", "WITH", "YOU",
    "DAY",
]

# Fixed value: a run of one to five letters A-Z that touches no other such letter.
TICKER_PATTERN = r"(?<![A-Z])\$?([A-Z]{1,5})(?![A-Z])"
SYMBOL_PATTERN = r"^[A-Z]{1,5}$"


def strip(text: Column | str) -> Column:
    """Remove whitespace of every kind at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalize_text(text: Column | str, max_chars: int | None = None) -> Column:
    """One space per whitespace run, none at the ends; ``max_chars`` code points if given."""
    collapsed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE_RUN, " "))
    return collapsed if max_chars is None else F.substring(collapsed, 1, max_chars)


def dedup_key(url: Column | str, text: Column | str) -> Column:
    """``url:`` or ``txt:`` plus a SHA-256; any non-empty URL wins, even a blank one."""
    by_url = F.concat(F.lit("url:"), F.sha2(F.lower(strip(url)), 256))
    by_text = F.concat(F.lit("txt:"), F.sha2(F.lower(normalize_text(text)), 256))
    link = url if isinstance(url, Column) else F.col(url)
    return F.when(link != "", by_url).otherwise(by_text)


def author_key(source: Column | str, author: Column | str) -> Column:
    """24 hex digits naming an author of a source; null when there is no author."""
    name = author if isinstance(author, Column) else F.col(author)
    digest = F.sha2(F.concat(source, F.lit(":"), author), 256)
    return F.when(name != "", F.substring(digest, 1, 24))


def ticker_candidates(text: Column | str) -> Column:
    """Every candidate symbol of the upper-cased text, in order, with repeats."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(upper, F.lit(TICKER_PATTERN), F.lit(1))


def drop_stop_tokens(symbols: Column | str) -> Column:
    return F.filter(symbols, lambda s: ~s.isin(STOP_TOKENS))


def keep_allowed(symbols: Column | str, allowed: Iterable[str] | None) -> Column:
    """Keep the allowed symbols, for lists small enough to be part of the plan."""
    column = symbols if isinstance(symbols, Column) else F.col(symbols)
    if allowed is None:
        return column
    names = sorted(set(allowed))
    return F.filter(column, lambda s: s.isin(names))


def ordered_distinct(symbols: Column | str) -> Column:
    return F.array_distinct(symbols)
