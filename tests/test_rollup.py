from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import comparable, enriched, rollup, same_rows
from registry import fixtures as fx
from tickertide.operators.merge import first_by_key, insert_if_absent
from tickertide.operators.rollup import mention_authors, merge_rollup, rollup_5m, rollup_to, sum_maps, unique_authors
from tickertide.plans.backfill import enrich_backlog, rebuild_rollup
from tickertide.schema import ROLLUP

DAY = datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def test_hand_made_rollup(spark):
    rows = [
        {"created_at": DAY, "tickers": ["AA", "BB"], "emotions": {"joy": 0.5}, "stance_label": "bullish", "source": "news", "source_weight": 1.2},
        {"created_at": DAY + timedelta(seconds=299), "tickers": ["AA"], "emotions": {"fear": 0.25, "joy": 0.25}, "stance_label": "bearish"},
        {"created_at": DAY + timedelta(seconds=1), "tickers": ["AA"], "emotions": {}, "stance_label": "news", "author": None, "source": "demo"},
        {"created_at": DAY + timedelta(seconds=300), "tickers": ["AA"], "emotions": {}, "author": ""},
        {"created_at": DAY + timedelta(seconds=301), "tickers": ["AA"], "emotions": None, "author": ""},
        {"created_at": DAY, "tickers": []},
    ]
    df = rollup_5m(enriched(spark, rows))
    assert df.columns == ROLLUP.fieldNames()
    got = {(r.ticker, r.bucket_start): r for r in df.collect()}
    assert set(got) == {("AA", DAY), ("BB", DAY), ("AA", DAY + timedelta(minutes=5))}
    first = got[("AA", DAY)]
    assert (first.mention_count, first.unique_authors) == (3, 2)  # news:ann and reddit:ann differ
    assert (first.news_count, first.reddit_count) == (1, 1)
    assert (first.bullish_count, first.bearish_count, first.neutral_count) == (1, 1, 1)
    assert first.weighted_mentions == pytest.approx(3.2)
    assert first.emotion_sums == {"joy": 0.75, "fear": 0.25}
    later = got[("AA", DAY + timedelta(minutes=5))]
    assert later.emotion_sums == {} and later.unique_authors == 0 and later.mention_count == 2


def test_invariants_on_documents(spark):
    posts = fx.enriched(spark, SF)
    rows = rollup_5m(posts)
    broken = rows.filter(
        (F.col("bullish_count") + F.col("bearish_count") + F.col("neutral_count") != F.col("mention_count"))
        | (F.col("sentiment_count") != F.col("mention_count"))
        | (F.col("unique_authors") > F.col("mention_count"))
    )
    assert broken.isEmpty()
    total = posts.agg(F.sum(F.size("tickers"))).first()[0]
    assert rows.agg(F.sum("mention_count")).first()[0] == total
    apart = unique_authors(posts)
    joined = rows.filter("unique_authors > 0").select("bucket_start", "ticker", "unique_authors")
    assert same_rows(joined, apart)


def test_emotion_sums_equal_sum_maps(spark):
    mentions = enriched(spark, [{"created_at": DAY, "emotions": e} for e in ({"joy": 0.5}, {"fear": 0.25, "joy": None}, {})])
    (row,) = sum_maps(mentions, ["source"], "emotions").collect()
    assert row.emotions == {"joy": 0.5, "fear": 0.25}
    (row,) = rollup_5m(mentions).collect()
    assert row.emotion_sums == {"joy": 0.5, "fear": 0.25}


def test_merge_in_three_parts_equals_whole(spark):
    posts = fx.enriched(spark, SF)
    part = F.pmod(F.hash("post_id"), F.lit(3))
    merged = rollup_5m(posts.filter(part == 0))
    for i in (1, 2):
        known = mention_authors(posts.filter(part < i))
        merged = merge_rollup(merged, rollup_5m(posts.filter(part == i), known_authors=known))
    assert same_rows(comparable(merged), comparable(rollup_5m(posts)))


def test_merge_of_empty_maps_and_new_rows(spark):
    a = rollup(spark, [{"bucket_start": DAY, "ticker": "AA", "emotion_sums": {}}])
    b = rollup(spark, [{"bucket_start": DAY, "ticker": "AA", "emotion_sums": {}}, {"bucket_start": DAY, "ticker": "BB", "emotion_sums": {"joy": 1.0}}])
    got = {r.ticker: r for r in merge_rollup(a, b).collect()}
    assert got["AA"].mention_count == 2 and got["AA"].emotion_sums == {}
    assert got["BB"].mention_count == 1 and got["BB"].emotion_sums == {"joy": 1.0}


def test_wider_window_equals_direct_sums(spark):
    rows = rollup_5m(fx.enriched(spark, SF))
    hours = rollup_to(rows, "1 hour").groupBy("ticker").agg(F.sum("mention_count").alias("n"))
    assert same_rows(hours, rows.groupBy("ticker").agg(F.sum("mention_count").alias("n")))


def test_hot_group_counts_exactly(spark):
    """One ticker, one bucket and one author pair hold nearly all mentions."""
    rows = spark.range(30_000).select(
        F.lit("reddit").alias("source"),
        F.concat(F.lit("p"), "id").alias("post_id"),
        F.lit(DAY).alias("created_at"),
        F.when(F.col("id") % 3 == 0, F.lit("bot")).otherwise(F.concat(F.lit("u"), F.col("id") % 7000)).alias("author"),
        F.array(F.when(F.col("id") % 100 == 0, "BB").otherwise("AA")).alias("tickers"),
        F.lit(0.5).alias("finbert_score"),
        F.lit("bullish").alias("stance_label"),
        F.lit(0.5).alias("conviction"),
        F.create_map(F.lit("joy"), F.lit(0.25)).alias("emotions"),
        F.lit(1.0).alias("source_weight"),
    )
    got = {r.ticker: r for r in rollup_5m(rows).collect()}
    expected = {
        r.t: r
        for r in rows.groupBy(F.col("tickers")[0].alias("t")).agg(F.count("*").alias("n"), F.count_distinct("author").alias("a")).collect()
    }
    for t in ("AA", "BB"):
        assert (got[t].mention_count, got[t].unique_authors) == (expected[t].n, expected[t].a)
        assert got[t].emotion_sums == {"joy": 0.25 * expected[t].n}


def test_insert_if_absent(spark):
    schema = "source string, post_id string, text string, seq int"
    stored = spark.createDataFrame([("news", "a", "old", 0)], schema)
    batch = spark.createDataFrame(
        [("news", "a", "new", 1), ("reddit", "a", "late", 3), ("reddit", "a", "first", 2), ("news", "b", "b", 4)] + [("news", "c", "c", 9)] * 500,
        schema,
    )
    got = insert_if_absent(stored, batch, ["source", "post_id"], ["seq"])
    assert sorted((r.source, r.post_id, r.text) for r in got.collect()) == [("news", "b", "b"), ("news", "c", "c"), ("reddit", "a", "first")]
    assert insert_if_absent(stored, batch, ["source", "post_id"]).count() == 3
    assert first_by_key(batch, ["source", "post_id"], ["seq"]).count() == 4


def test_backfill(spark):
    raw = fx.posts(spark, SF).select("source", "post_id", "created_at", "author", "text", "url", "meta")
    done = enrich_backlog(raw, fx.length_scorers(), fx.ALLOW)
    assert 0 < done.count() < raw.count()
    doubled = done.unionByName(done)
    assert rebuild_rollup(doubled).agg(F.sum("mention_count")).first()[0] == done.agg(F.sum(F.size("tickers"))).first()[0]


def test_rollup_of_written_authors_is_the_rollup(spark, at):
    """Null times, authors, weights and emotions included; no row carries an author beside the measures."""
    rows = [
        {"created_at": at("09:00"), "author": "ann", "tickers": ["AA", "BB"]},
        {"created_at": at("09:01"), "author": "ann", "emotions": {"joy": 0.25, "anger": None}},
        {"created_at": at("09:02"), "author": None, "emotions": None, "source": "news"},
        {"created_at": at("09:07"), "author": "", "emotions": {}, "source_weight": None, "stance_label": "bearish"},
        {"created_at": at("09:11"), "author": "bob", "source_weight": None, "stance_label": None},
        {"created_at": None, "author": "ann"},
        {"created_at": None, "author": "bob", "tickers": ["AA", None]},
        {"created_at": at("09:30"), "author": "eve", "tickers": []},
    ]
    posts = enriched(spark, rows)
    authors = mention_authors(posts)
    split = rollup_5m(posts, new_authors=authors)
    assert split.schema.simpleString() == rollup_5m(posts).schema.simpleString()
    assert same_rows(comparable(split), comparable(rollup_5m(posts)))
    known = mention_authors(posts.where("post_id = 'p0'"))
    fresh = authors.join(known, known.columns, "left_anti")
    assert same_rows(comparable(rollup_5m(posts, new_authors=fresh)), comparable(rollup_5m(posts, known_authors=known)))
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan


def test_rebuild_counts_each_stored_post_once(spark, at):
    posts = enriched(spark, [{"created_at": at(f"09:{i:02d}"), "author": f"u{i % 7}"} for i in range(40)])
    rebuilt = rebuild_rollup(posts.unionByName(posts).unionByName(posts.where("post_id like '%3'")))
    assert same_rows(comparable(rebuilt), comparable(rollup_5m(posts)))
    plan = rebuilt._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[_hash" in plan  # the long sort compares hashes first
