from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickertide.operators.dedup import dedup_batch_ttl

DAY = datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, id string, text string"


def brute(rows, ttl_us):
    """Read in (time, id) order; keep unless the key was kept at most the ttl earlier."""
    kept, last = [], {}
    for key, ts, ident, _ in sorted(set(rows), key=lambda r: (r[1], r[2])):
        if key not in last or (ts - last[key]) > timedelta(microseconds=ttl_us):
            last[key] = ts
            kept.append((key, ts, ident))
    return sorted(kept)


def run(spark, rows, ttl_s, hot_rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = dedup_batch_ttl(df, "key", "ts", ["id"], ttl_s, hot_rows)
    return sorted((r.key, r.ts, r.id) for r in out.collect())


@pytest.mark.parametrize("hot_rows", [1_000, 0])
def test_boundary_and_non_sliding(spark, hot_rows):
    hour = timedelta(hours=1)
    rows = [
        ("k", DAY, "a", "x"),
        ("k", DAY + hour / 2, "b", "x"),
        ("k", DAY + hour, "c", "x"),  # exactly the ttl: still a duplicate
        ("k", DAY + hour + timedelta(microseconds=1), "d", "x"),  # kept, "b" did not refresh
        ("k", DAY, "a2", "x"),  # same instant, later id
        ("k", DAY, "a", "x"),  # redelivered
        ("j", DAY, "e", "x"),
    ]
    kept = [i for _, _, i in run(spark, rows, 3600, hot_rows)]
    assert kept == ["e", "a", "d"]


@pytest.mark.parametrize("hot_rows", [10_000, 40, 0])
@pytest.mark.parametrize("ttl", [0.00001, 7, 100])
def test_against_brute_force(spark, hot_rows, ttl):
    rng = random.Random(int(ttl * 100) + hot_rows)
    rows = []
    for i in range(600):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}"
        step = rng.choice([1, 1_000, 1_000_000])
        ts = DAY + timedelta(microseconds=rng.randrange(0, 1000) * step)
        rows.append((key, ts, f"p{i}", "x"))
    rows += rng.sample(rows, 30)
    assert run(spark, rows, ttl, hot_rows) == brute(rows, round(ttl * 1_000_000))


def test_dense_key_without_any_gap(spark):
    """A row every second for hours: the chain never restarts."""
    rows = [("k", DAY + timedelta(seconds=s), f"{s:05d}", "x") for s in range(0, 9000)]
    expected = [f"{s:05d}" for s in range(0, 9000, 61)]
    assert [i for _, _, i in run(spark, rows, 60, 100)] == expected


def test_one_instant_in_many_copies(spark):
    df = spark.range(20_000).select(
        F.lit("k").alias("key"), F.lit(DAY).alias("ts"), (F.col("id") % 5).cast("string").alias("id"), F.lit("x").alias("text")
    )
    assert [r.id for r in dedup_batch_ttl(df, "key", "ts", ["id"]).collect()] == ["0"]


@pytest.mark.parametrize("hot_rows", [1_000, 0])
def test_rows_without_key_or_time_are_kept(spark, hot_rows):
    rows = [(None, DAY, "a", "x"), (None, DAY, "b", "x"), ("k", None, "c", "x"), ("k", DAY, None, "x"), ("k", DAY, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = dedup_batch_ttl(df, "key", "ts", ["id"], 60, hot_rows).collect()
    assert sorted((r.key or "", r.id or "") for r in got) == [("", "a"), ("", "b"), ("k", ""), ("k", "c")]
