"""Physical plans: what is pushed, shuffled, broadcast and evaluated how often."""

from __future__ import annotations

import re

import pytest

from registry import fixtures as fx
from registry.queries import QUERIES
from tickertide.operators.cursors import newest_per_batch
from tickertide.operators.rollup import rollup_5m
from tickertide.operators.tickers import extract_tickers
from tickertide.plans.ranking import movers_api
from tickertide.schema import ROLLUP

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "name",
    sorted(n for n in QUERIES if not n.startswith(("stream", "dedup_batch", "backfill"))),
)
def test_no_cross_joins(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_allowlist_is_a_hash_set_without_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df = extract_tickers(docs, "text", fx.ALLOW).select("tickers")
    assert "INSET" in optimized(df)
    assert "Exchange" not in physical(df)
    assert re.search(r"ReadSchema: struct<text:string>", physical(df))


def test_rollup_evaluates_the_ticker_pattern_once(spark):
    assert optimized(rollup_5m(fx.enriched(spark, SF))).count("regexp_extract_all") == 1


def test_rollup_shuffles_twice_and_never_collects_authors(spark):
    posts = spark.createDataFrame([], fx.enriched(spark, SF).schema)
    plan = physical(rollup_5m(posts))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "collect_set" not in plan


def test_movers_reads_the_rollup_once_with_pushed_bounds(spark, tmp_path):
    spark.createDataFrame([], ROLLUP).write.parquet(str(tmp_path / "r"))
    stored = spark.read.schema(ROLLUP).parquet(str(tmp_path / "r"))
    plan = physical(movers_api(stored, fx.AS_OF))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "GreaterThanOrEqual(bucket_start" in plan
    assert "TakeOrderedAndProject" in plan
    joined = physical(movers_api(stored, fx.AS_OF, single_scan=False))
    assert joined.count("FileScan") == 2 and joined.count("GreaterThanOrEqual(bucket_start") == 2
    assert "author" not in re.findall(r"ReadSchema: (.*)", plan)[0]


def test_newest_rows_are_cut_before_the_shuffle(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    plan = physical(newest_per_batch(df, "event_type", ["ts"], 5))
    assert plan.count("WindowGroupLimit") == 2  # a partial one below the exchange
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_stored_rankings_prune_days_and_sum_at_once(spark, tmp_path):
    from datetime import datetime

    from helpers import enriched
    from tickertide.plans.ranking import movers_api_stored, movers_web_stored, trending_stored
    from tickertide.streaming.rollup import persist_and_roll

    root = str(tmp_path / "out")
    persist_and_roll(root, run="r")(enriched(spark, [{"post_id": "a", "created_at": datetime(2024, 1, 1)}]), 0)
    for ranking, exchanges in ((trending_stored, 1), (movers_web_stored, 1), (movers_api_stored, 2)):
        plan = physical(ranking(spark, root, fx.AS_OF))
        assert plan.count("Exchange hashpartitioning") == exchanges
        assert "Generate" not in plan and "Expand" not in plan
        assert re.search(r"PartitionFilters: \[[^\n]*\(day#\d+ >=", plan)
