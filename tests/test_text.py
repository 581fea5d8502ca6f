from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from registry.fixtures import ALLOW
from tickertide.functions.quality import quality_flags
from tickertide.functions.text import (
    STOP_TOKENS,
    author_key,
    dedup_key,
    normalize_text,
    strip,
    ticker_candidates,
)
from tickertide.functions.time import floor_5m, iso_z, parse_iso_utc, utc_date
from tickertide.operators.tickers import extract_tickers

EDGE_TEXTS = [
    "", " ", "  \x1c\x1f ", "a\x1cb  c\n\n", "straße GO", "$TSLA to the moon", "A$TSLA", "TSLA2",
    "ABCDEF GH", "DON'T stop", "AA bb AA $bb", "ﬁne ŉ", "x" * 6000, ("word \n" * 2000), "naïve É ÉA AÉ", None,
]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def py_norm(text, cut=None):
    return " ".join((text or "").split())[:cut]


def py_runs(text):
    """Maximal runs of A-Z of at most five letters."""
    return [run for run in re.split("[^A-Z]+", (text or "").upper()) if 1 <= len(run) <= 5]


def py_tickers(text, allow=None):
    kept = [r for r in py_runs(text) if r not in STOP_TOKENS and (allow is None or r in allow)]
    return list(dict.fromkeys(kept))


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    return docs.unionByName(spark.createDataFrame([(t,) for t in EDGE_TEXTS], "text string"))


def test_normalize_and_strip(texts):
    rows = texts.select("text", normalize_text("text").alias("n"), strip("text").alias("s")).collect()
    for r in rows:
        assert r.n == py_norm(r.text)
        assert r.s == (None if r.text is None else r.text.strip())
    short = texts.select("text", normalize_text("text", 7).alias("n")).collect()
    assert all(r.n == py_norm(r.text, 7) for r in short)


def test_tickers_follow_the_rule(texts, spark):
    allow = set(ALLOW) | {"GO", "AA", "BB", "TSLA"}
    rows = texts.select("text", ticker_candidates("text").alias("c")).collect()
    assert all(r.c == py_runs(r.text) for r in rows)
    for found in (
        extract_tickers(texts, "text", sorted(allow)),
        extract_tickers(texts, "text", spark.createDataFrame([(s,) for s in allow], "symbol string")),
        extract_tickers(texts, "text", sorted(allow), literal_limit=0),
        extract_tickers(texts, "text", spark.createDataFrame([(s,) for s in allow], "symbol string"), literal_limit=0),
    ):
        for r in found.collect():
            assert r.tickers == py_tickers(r.text, allow)
    assert all(r.tickers == py_tickers(r.text) for r in extract_tickers(texts, "text").collect())


def test_empty_allowlist_keeps_nothing(texts):
    assert extract_tickers(texts, "text", []).filter(F.size("tickers") > 0).isEmpty()


def test_dedup_key_prefers_any_non_empty_url(spark):
    rows = [
        (" HTTP://Ex.org/1 ", "x"), ("http://ex.org/1", "y"), ("  ", "z"), (" ", "w"), ("", "Some  Text "),
        (None, "some text"), (None, ""),
    ]
    df = spark.createDataFrame(rows, "url string, text string")
    keys = [r[0] for r in df.select(dedup_key("url", "text")).collect()]
    link, blank, text = "url:" + sha("http://ex.org/1"), "url:" + sha(""), "txt:" + sha("some text")
    assert keys == [link, link, blank, blank, text, text, "txt:" + sha("")]


def test_author_key(spark):
    df = spark.createDataFrame([("news", "ann"), ("news", ""), ("news", None)], "s string, a string")
    keys = [r[0] for r in df.select(author_key("s", "a")).collect()]
    assert keys == [sha("news:ann")[:24], None, None]


def test_quality_flags(spark):
    df = spark.createDataFrame([([], " \n"), (["A"], "a"), ([], "x"), (["A"], None)], "t array<string>, x string")
    flags = [r[0] for r in df.select(quality_flags("t", "x")).collect()]
    assert flags == [["no_ticker", "empty_text"], [], ["no_ticker"], ["empty_text"]]


def test_parse_iso_utc(spark):
    cases = {
        "2024-01-01T10:00:00Z": "2024-01-01T10:00:00Z",
        "2024-01-01T10:00:00": "2024-01-01T10:00:00Z",
        "2024-01-01 10:00:00.5": "2024-01-01T10:00:00.500000Z",
        "2024-01-01T10:00:00+02:00": "2024-01-01T08:00:00Z",
        "2024-01-01T10:00:00.000001-05:30": "2024-01-01T15:30:00.000001Z",
        "2024-01-01": "2024-01-01T00:00:00Z",
        "yesterday": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [r[0] for r in df.select(iso_z(parse_iso_utc("s"))).collect()]
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == list(cases.values())


def test_floor_and_date(spark):
    df = spark.createDataFrame([("2024-01-01T23:59:59.999999Z",), ("1969-12-31T23:58:00Z",), ("2024-01-01T00:05:00Z",)], "s string")
    rows = df.select(parse_iso_utc("s").alias("t")).select(iso_z(floor_5m("t")), utc_date("t").cast("string")).collect()
    assert [tuple(r) for r in rows] == [
        ("2024-01-01T23:55:00Z", "2024-01-01"),
        ("1969-12-31T23:55:00Z", "1969-12-31"),
        ("2024-01-01T00:05:00Z", "2024-01-01"),
    ]
