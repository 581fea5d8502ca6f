"""The chain raw topic, arrivals, enriched topic, rollup; and the state of the time-to-live rule."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import comparable, same_rows
from tickertide.operators.dedup import dedup_batch_ttl
from tickertide.operators.rollup import rollup_5m
from tickertide.plans.backfill import enrich_backlog
from tickertide.schema import RAW_POST
from tickertide.sources.tables import read_rollup
from tickertide.sources.topics import read_enriched_posts, read_raw_posts, write_raw_posts
from tickertide.streaming.dedup import STATE_GROUPS, STATE_SLOTS, dedup_stream_event_time
from tickertide.streaming.enrich import kept_posts, stage_arrivals, start_arrivals, start_enrich
from tickertide.streaming.rollup import start_rollup

DAY = datetime(2024, 1, 1)
NOW = {"availableNow": True}
ALLOW = ["AA", "BB"]
KEYED = "post_id string, dedup_key string, created_at timestamp"


def scorers():
    def make():
        def finance(texts):
            return [{"Positive": len(t) % 7 / 8} for t in texts]

        def emotion(texts):
            return [{"Joy": 0.5} for _ in texts]

        def stance(texts):
            return [{"bullish": 0.75, "news": 0.25} for _ in texts]

        return finance, emotion, stance

    return make


def raw_rows(n=90):
    """Reposts of a few texts over some hours, in order of time; some rows come twice, some are not valid."""
    rows = []
    for i in range(n):
        at = DAY + timedelta(minutes=4 * i)
        rows.append(("news" if i % 3 else "reddit", f"p{i}", at, f"u{i % 5}", f"buy AA {i % 4}" + " see BB" * (i % 2), None, {}))
        if i % 6 == 0:
            rows.append(("reddit", f"copy{i}", at, "eve", f"buy  AA {i % 4}" + " see BB" * (i % 2), None, {}))
        if i % 10 == 0:
            rows += [rows[-1], ("reddit", f"empty{i}", at, None, "", None, {})]
    return rows


def run_chain(spark, folder, sink, raw, **options):
    start_arrivals(raw, f"{folder}/arrived", f"{folder}/cp1", f"{folder}/bad", NOW).awaitTermination()
    start_enrich(
        spark, f"{folder}/arrived", sink, f"{folder}/cp2", scorers(), ALLOW, trigger=NOW, **options
    ).awaitTermination()


def test_chain_over_several_files_equals_batch(spark, tmp_path):
    rows = raw_rows()
    topic, sink = str(tmp_path / "raw"), str(tmp_path / "enriched")
    cut = rows[len(rows) // 2][2]
    for part in ([r for r in rows if r[2] < cut], [r for r in rows if r[2] >= cut]):  # one span of time after the other
        write_raw_posts(spark.createDataFrame(part, RAW_POST).coalesce(1), topic)
        run_chain(spark, str(tmp_path), sink, read_raw_posts(spark, topic, streaming=True, max_files=1), max_files=1)
        start_rollup(
            read_enriched_posts(spark, sink, streaming=True), str(tmp_path / "out"), str(tmp_path / "cp3"), trigger=NOW
        ).awaitTermination()
    whole = enrich_backlog(spark.createDataFrame(rows, RAW_POST), scorers(), ALLOW)
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    columns = [c for c in whole.columns if c not in ("enriched_at", "meta", "emotions", "stance_probs")]
    got = read_enriched_posts(spark, sink).cache()
    assert got.count() == whole.count() > 10
    assert same_rows(whole.select(*columns), got.select(*columns))
    assert same_rows(comparable(read_rollup(spark, str(tmp_path / "out"))), comparable(rollup_5m(whole)))
    assert spark.read.json(str(tmp_path / "bad")).count() == sum(r[4] == "" for r in rows)


def test_replayed_arrivals_change_nothing(spark, tmp_path):
    root = str(tmp_path / "arrived")
    posts = spark.createDataFrame(raw_rows(30), RAW_POST)
    write = stage_arrivals(root)
    write(posts, 0)
    before = {t: sorted(map(str, spark.read.parquet(f"{root}/{t}").collect())) for t in ("posts", "arrivals")}
    write(posts.limit(3), 0)
    write(posts, 0)
    assert before == {t: sorted(map(str, spark.read.parquet(f"{root}/{t}").collect())) for t in ("posts", "arrivals")}
    # One row for each key and instant, without texts.
    arrivals = spark.read.parquet(f"{root}/arrivals")
    assert arrivals.count() == arrivals.select("dedup_key", "created_at").distinct().count() < posts.count()
    assert "text" not in arrivals.columns
    # A replayed enrich batch reads the same posts, one for each kept row.
    kept = arrivals.where("post_id like 'p%'")
    assert kept_posts(kept.unionByName(kept), root).count() == kept.count()


def test_only_the_folders_of_the_batch_are_read(spark, tmp_path):
    root = str(tmp_path / "arrived")
    posts = spark.createDataFrame(raw_rows(20), RAW_POST)
    for batch in range(4):
        stage_arrivals(root)(posts.withColumn("post_id", F.concat("post_id", F.lit(f"-{batch}"))), batch)
    kept = spark.read.parquet(f"{root}/arrivals").where("batch = 2")
    found = kept_posts(kept, root)
    assert "PartitionFilters: [isnotnull(batch" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == kept.count()


def test_rows_of_a_stream_that_hold_nulls(spark, tmp_path):
    """No message of the topic is valid: nothing arrives, all goes to the quarantine."""
    topic = str(tmp_path / "raw")
    lines = ["{broken", '{"source": "news", "post_id": "m", "created_at": "garbage", "text": "x"}', "{}"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(topic)
    run_chain(spark, str(tmp_path), str(tmp_path / "enriched"), read_raw_posts(spark, topic, streaming=True))
    assert spark.read.json(str(tmp_path / "bad")).count() == 3
    assert read_enriched_posts(spark, str(tmp_path / "enriched")).isEmpty()


# --- state of the rule -----------------------------------------------------------


def drain(spark, folder, schema, out, **options):
    query = (
        dedup_stream_event_time(spark.readStream.schema(schema).parquet(str(folder)), ids=("post_id",), **options)
        .writeStream.format("parquet")
        .option("path", str(out))
        .option("checkpointLocation", f"{out}-cp")
        .trigger(**NOW)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(str(out)), query


def test_late_rows_meet_the_instants_around_them(spark, tmp_path):
    schema = spark.createDataFrame([], KEYED).schema
    hour = timedelta(hours=1)
    batches = [
        [("a", "k", DAY + 100 * hour), ("b", "k", DAY + 102 * hour)],
        [("c", "k", DAY + 101 * hour), ("d", "k", DAY + 63.5 * hour), ("e", "k", DAY + 99.5 * hour)],
        [("f", "k", DAY + 64.2 * hour), ("g", "k", DAY + 64.6 * hour), ("h", "j", DAY), ("i", None, DAY), ("j", "k", None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        kept, _ = drain(spark, tmp_path / "in", schema, tmp_path / "out")
    # c is within an hour of a; f of d, across the border of a cell of 64 hours; g is beyond d.
    assert sorted(r.post_id for r in kept.collect()) == ["a", "b", "d", "e", "g", "h", "i", "j"]


def test_a_row_does_not_pay_for_what_its_key_has_kept(spark, tmp_path):
    """A key with a million kept instants: the next rows open two cells, not all."""
    n, ttl = 1_000_000, 60
    schema = spark.createDataFrame([], KEYED).schema
    at = (F.unix_timestamp(F.lit(DAY)) + F.col("id") * (ttl + 1)).cast("timestamp")
    rows = spark.range(n).select(F.concat(F.lit("p"), "id").alias("post_id"), F.lit("k").alias("dedup_key"), at.alias("created_at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    kept, _ = drain(spark, tmp_path / "in", schema, tmp_path / "out", ttl_seconds=ttl)
    assert kept.count() == n
    late = [(f"late{i}", "k", DAY + timedelta(seconds=(ttl + 1) * i * 9_000 + i)) for i in range(1, 100)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    started = time.time()
    kept, query = drain(spark, tmp_path / "in", schema, tmp_path / "out", ttl_seconds=ttl)
    assert kept.count() == n  # an instant is kept every 61 seconds
    state = query.lastProgress["stateOperators"][0]
    assert state["customMetrics"]["rocksdbGetCount"] < 2_000 and time.time() - started < 60


def test_lateness_frees_the_state(spark, tmp_path):
    schema = spark.createDataFrame([], KEYED).schema
    sizes = []
    for day in (0, 30, 60, 90):
        rows = [(f"{day}-{i}", f"k{i}", DAY + timedelta(days=day)) for i in range(20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        kept, query = drain(spark, tmp_path / "in", schema, tmp_path / "out", lateness_seconds=86_400)
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert kept.count() == 80
    assert sizes[-1] <= 2 * sizes[0]


def test_many_keys_share_their_state(spark, tmp_path):
    """One entry of state for each slot and cell, not for each key."""
    schema = spark.createDataFrame([], KEYED).schema
    rows = spark.range(20_000).select(
        F.concat(F.lit("p"), "id").alias("post_id"),
        F.concat(F.lit("k"), "id").alias("dedup_key"),
        F.lit(DAY).cast("timestamp").alias("created_at"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    kept, query = drain(spark, tmp_path / "in", schema, tmp_path / "out")
    assert kept.count() == 20_000
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] <= STATE_GROUPS * STATE_SLOTS  # 20 000 before


@pytest.mark.parametrize("seed", [1])
def test_rows_in_order_equal_the_batch_rule(spark, tmp_path, seed):
    schema = spark.createDataFrame([], KEYED).schema
    moment = F.timestamp_seconds(F.lit(1_704_067_200) + F.floor(F.rand(seed) * 40_000)).alias("created_at")
    key = F.concat(F.lit("k"), F.floor(F.rand(seed + 7) * 5).cast("string")).alias("dedup_key")
    posts = spark.range(400).select(F.concat(F.lit("p"), "id").alias("post_id"), key, moment)
    posts = spark.createDataFrame(posts.collect(), schema)
    expected = dedup_batch_ttl(posts, "dedup_key", "created_at", ["post_id"])
    for low in range(0, 40_000, 10_000):
        span = F.col("created_at").cast("long").between(1_704_067_200 + low, 1_704_067_200 + low + 9_999)
        posts.where(span).write.mode("append").parquet(str(tmp_path / "in"))
        kept, _ = drain(spark, tmp_path / "in", schema, tmp_path / "out")
    assert same_rows(kept, expected)
