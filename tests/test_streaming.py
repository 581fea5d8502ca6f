from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import comparable, enriched, same_rows
from tickertide.operators.rollup import rollup_5m
from tickertide.operators.tickers import extract_tickers
from tickertide.plans.backfill import enrich_backlog, rebuild_from_tables
from tickertide.schema import ENRICHED_POST, RAW_POST
from tickertide.sources.tables import (
    AUTHOR_TABLE,
    ENRICHED_TABLE,
    RAW_TABLE,
    ROLLUP_TABLE,
    pack_tables,
    read_rollup,
    read_table,
)
from tickertide.sources.topics import read_enriched_posts, read_raw_posts, write_enriched_posts, write_raw_posts
from tickertide.streaming.dedup import dedup_stream_event_time, dedup_stream_ttl, dedup_stream_watermark
from tickertide.streaming.rollup import enrich_stream, persist_and_roll, rollup_stream, start_rollup

DAY = datetime(2024, 1, 1)
NOW = {"availableNow": True}


def sample(spark, n: int = 60):
    """Posts over two days with shared authors, tickers and emotion labels."""
    rows = []
    for i in range(n):
        rows.append(
            {
                "post_id": f"p{i}",
                "source": "news" if i % 3 == 0 else "reddit",
                "created_at": DAY + timedelta(minutes=(i * 37) % 2880, seconds=i),
                "author": None if i % 7 == 0 else f"u{i % 4}",
                "tickers": [["AA", "BB"], ["AA"], [], ["CC", "AA"]][i % 4],
                "emotions": [{"joy": 0.25}, {"fear": 0.5, "joy": 0.125}, {}][i % 3],
                "stance_label": ["bullish", "bearish", "meme"][i % 3],
                "finbert_score": (i % 9 - 4) / 8,
            }
        )
    return enriched(spark, rows)


def write_parts(df, folder, parts: int = 3) -> None:
    """Split a frame over several files, one per micro-batch."""
    for i in range(parts):
        part = df.filter(F.pmod(F.hash("post_id"), F.lit(parts)) == i).coalesce(1)
        part.write.mode("append").parquet(str(folder))


def stream_of(spark, folder, schema=ENRICHED_POST):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("scope", ["all", "day"])
def test_stream_equals_batch_over_several_batches(spark, tmp_path, scope):
    posts = sample(spark)
    again = posts.filter(F.pmod(F.hash("post_id"), F.lit(4)) == 1)
    write_parts(posts, tmp_path / "in")
    write_parts(again, tmp_path / "in", 1)  # redelivered in a later batch
    query = start_rollup(
        stream_of(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), scope, NOW
    )
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    got = comparable(read_rollup(spark, str(tmp_path / "out")))
    assert same_rows(got, comparable(rollup_5m(posts)))
    for table in (RAW_TABLE, ENRICHED_TABLE):
        stored = read_table(spark, str(tmp_path / "out"), table)
        assert stored.count() == posts.count()  # posts without a ticker are kept
        assert stored.select("source", "post_id").distinct().count() == posts.count()


def test_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    posts = sample(spark)
    run = persist_and_roll(root)
    first = posts.filter("substring(post_id, 2) < '4'")
    second = posts.unionByName(posts.limit(5))
    run(first, 0)
    run(second, 1)
    before = comparable(read_rollup(spark, root)).collect()
    run(second, 1)
    run(second, 1)
    after = comparable(read_rollup(spark, root)).collect()
    assert sorted(map(str, before)) == sorted(map(str, after))
    assert same_rows(comparable(read_rollup(spark, root)), comparable(rollup_5m(posts)))
    authors = read_table(spark, root, AUTHOR_TABLE)
    keys = ["bucket_start", "ticker", "author_key"]
    assert authors.count() == authors.select(*keys).distinct().count()


def test_a_post_that_comes_again_with_another_day_counts_once(spark, tmp_path):
    root = str(tmp_path / "out")
    run = persist_and_roll(root, run="r")
    for batch, day in enumerate((1, 2)):
        run(enriched(spark, [{"post_id": "a", "created_at": datetime(2024, 1, day)}]), batch)
    assert read_table(spark, root, RAW_TABLE).count() == 1
    assert [r.mention_count for r in read_rollup(spark, root).collect()] == [1]


def test_very_late_post_updates_its_old_bucket(spark, tmp_path):
    root = str(tmp_path / "out")
    run = persist_and_roll(root)
    run(enriched(spark, [{"post_id": "a", "created_at": DAY + timedelta(days=30)}]), 0)
    run(enriched(spark, [{"post_id": "b", "created_at": DAY}]), 1)
    run(enriched(spark, [{"post_id": "c", "created_at": DAY}]), 2)
    rows = {r.bucket_start: r for r in read_rollup(spark, root).collect()}
    assert rows[DAY].mention_count == 2 and rows[DAY].unique_authors == 1
    assert rows[DAY].emotion_sums == {"joy": 1.0}


def test_packed_tables_read_the_same_and_go_on(spark, tmp_path):
    root, packed = str(tmp_path / "out"), str(tmp_path / "packed")
    run = persist_and_roll(root)
    posts = sample(spark)
    run(posts.limit(20), 0)
    run(posts.limit(0), 1)  # an empty batch
    run(posts.limit(40), 2)
    pack_tables(spark, root, packed, "by-hand", 2)
    assert same_rows(comparable(read_rollup(spark, packed)), comparable(read_rollup(spark, root)))
    assert read_table(spark, packed, ROLLUP_TABLE).select("batch_id").distinct().count() == 1
    persist_and_roll(packed)(posts, 3)
    assert same_rows(comparable(read_rollup(spark, packed)), comparable(rollup_5m(posts)))
    assert read_table(spark, packed, RAW_TABLE).count() == posts.count()


def test_only_empty_batches(spark, tmp_path):
    root = str(tmp_path / "out")
    persist_and_roll(root)(sample(spark).limit(0), 0)
    assert read_rollup(spark, root).isEmpty()
    assert read_rollup(spark, str(tmp_path / "never written")).isEmpty()


def test_read_rollup_since_prunes_days(spark, tmp_path):
    root = str(tmp_path / "out")
    persist_and_roll(root)(sample(spark), 0)
    recent = read_rollup(spark, root, since=DAY + timedelta(days=1, minutes=30))
    assert recent.agg(F.min("bucket_start")).first()[0] >= DAY + timedelta(days=1, minutes=30)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "day#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_bounded_lateness_stream_emits_closed_buckets(spark, tmp_path):
    posts = sample(spark)
    closing = enriched(spark, [{"post_id": "z", "created_at": DAY + timedelta(days=9), "tickers": ["ZZ"]}])
    write_parts(posts, tmp_path / "in", 1)
    write_parts(closing, tmp_path / "in", 1)
    (
        rollup_stream(stream_of(spark, tmp_path / "in"), "3 days")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append")
        .trigger(**NOW)
        .start()
        .awaitTermination()
    )
    got = spark.read.schema(rollup_5m(posts).schema).parquet(str(tmp_path / "out"))
    assert same_rows(comparable(got), comparable(rollup_5m(posts)))


RAW_ROWS = [
    ("reddit", "a", DAY, "ann", "buy AA", None, {}),
    ("reddit", "b", DAY + timedelta(minutes=1), "bob", "buy  aa ", None, {}),
    ("news", "c", DAY + timedelta(minutes=2), None, "see BB", "http://x", {}),
    ("reddit", "d", DAY + timedelta(minutes=3), None, "link", " HTTP://X ", {}),
    ("reddit", "e", DAY + timedelta(minutes=4), None, "", None, {}),
]


def scorers():
    def make():
        def finance(texts):
            return [{"Positive": 0.5, "Negative": 0.25} for _ in texts]

        def emotion(texts):
            return [{"Joy": 0.5} for _ in texts]

        def stance(texts):
            return [{"bullish": 0.75, "news": 0.25} for _ in texts]

        return finance, emotion, stance

    return make


def test_two_chained_jobs_over_topics(spark, tmp_path):
    raw_topic, enriched_topic = str(tmp_path / "raw"), str(tmp_path / "enriched")
    write_raw_posts(spark.createDataFrame(RAW_ROWS, RAW_POST), raw_topic)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(raw_topic)
    stream = enrich_stream(read_raw_posts(spark, raw_topic, streaming=True), scorers(), ["AA", "BB"])
    write_enriched_posts(stream, enriched_topic, str(tmp_path / "cp1"), NOW).awaitTermination()
    enriched_rows = read_enriched_posts(spark, enriched_topic)
    # One of each repost pair, not the empty text, not the broken message.
    assert enriched_rows.count() == 2
    assert {r.source_weight for r in enriched_rows.collect()} <= {1.0, 1.2}
    query = start_rollup(
        read_enriched_posts(spark, enriched_topic, streaming=True),
        str(tmp_path / "out"),
        str(tmp_path / "cp2"),
        trigger=NOW,
    )
    query.awaitTermination()
    rolled = read_rollup(spark, str(tmp_path / "out")).collect()
    assert "AA" in {r.ticker for r in rolled}
    assert all(abs(r.sentiment_sum - 0.25) < 1e-12 and r.emotion_sums == {"joy": 0.5} for r in rolled)


def run_dedup(stream, tmp_path, out="out"):
    return (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / out))
        .option("checkpointLocation", str(tmp_path / f"cp-{out}"))
        .trigger(**NOW)
        .start()
    )


KEYED = "post_id string, dedup_key string, created_at timestamp"


def test_watermark_dedup_over_batches(spark, tmp_path):
    rows = [("a", "k", DAY), ("b", "k", DAY + timedelta(minutes=30)), ("c", "j", DAY)]
    later = [("d", "k", DAY + timedelta(minutes=50)), ("e", "l", DAY)]
    folder = tmp_path / "in"
    for part in (rows, later):
        spark.createDataFrame(part, KEYED).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.1)
    for thin in (True, False):
        stream = dedup_stream_watermark(stream_of(spark, folder, rows_schema(spark)), thin=thin)
        run_dedup(stream, tmp_path, f"out{thin}").awaitTermination()
        kept = spark.read.schema(KEYED).parquet(str(tmp_path / f"out{thin}")).collect()
        assert sorted(r.dedup_key for r in kept) == ["j", "k", "l"]


def rows_schema(spark):
    return spark.createDataFrame([], KEYED).schema


@pytest.fixture
def no_empty_batches(spark):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_processing_time_ttl_expires_and_does_not_slide(spark, tmp_path, no_empty_batches):
    folder = tmp_path / "in"
    schema = rows_schema(spark)

    def deliver(post_id):
        rows = [(post_id, "k", DAY), (f"{post_id}-copy", "k", DAY)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = dedup_stream_ttl(spark.readStream.schema(schema).parquet(str(folder)), ttl_seconds=20)
        run_dedup(stream, tmp_path).awaitTermination()
        return sorted(
            r.post_id for r in spark.read.schema(KEYED).parquet(str(tmp_path / "out")).collect()
        )

    assert deliver("a") == ["a"]
    started = time.time()
    assert deliver("b") == ["a"]  # within the time to live
    time.sleep(max(0.0, 21.5 - (time.time() - started)))
    # The hit of "b" did not extend the life of "a".
    assert deliver("c") == ["a", "c"]


def test_late_news_survives_next_to_fresh_posts(spark, tmp_path):
    """Three-hour-old news beside fresh social posts, over three micro-batches: nothing is lost."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    schema = "source string, post_id string, dedup_key string, created_at timestamp"
    rows = []
    for batch in range(3):
        part = [("reddit", f"r{batch}-{i}", f"r{batch}-{i}", DAY + timedelta(hours=12, minutes=batch)) for i in range(5)]
        part += [("news", f"n{batch}-{i}", f"n{batch}-{i}", DAY + timedelta(hours=9, minutes=batch)) for i in range(5)]
        part += [("news", f"copy{batch}", f"n{batch}-0", DAY + timedelta(hours=9, minutes=batch + 5))]
        part += [("news", f"null{batch}", None, DAY), ("news", f"untimed{batch}", "k", None)]
        rows += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.1)
    stream = dedup_stream_event_time(stream_of(spark, folder, spark.createDataFrame([], schema).schema))
    run_dedup(stream, tmp_path).awaitTermination()
    kept = {r.post_id for r in spark.read.schema(schema).parquet(out).collect()}
    assert kept == {r[1] for r in rows if not r[1].startswith("copy")}


@pytest.mark.parametrize("files", [1, 4, 16])
def test_stream_dedup_does_not_depend_on_the_micro_batches(spark, files):
    from registry.queries import QUERIES, q_stream_dedup
    from tickertide.operators.dedup import dedup_batch_ttl
    from registry import fixtures as fx

    sf = "/root/testdata/sf0.001"
    whole = dedup_batch_ttl(fx.event_posts(fx.events(spark, sf)), "dedup_key", "created_at", ["post_id"])
    expected = sorted(r.post_id for r in whole.select("post_id").collect())
    assert sorted(r.post_id for r in q_stream_dedup(spark, sf, files).collect()) == expected
    assert "stream_dedup" in QUERIES


def test_a_fresh_checkpoint_does_not_touch_what_is_stored(spark, tmp_path):
    root = str(tmp_path / "out")
    posts = sample(spark)
    persist_and_roll(root, run="one")(posts.limit(40), 0)
    before = comparable(read_rollup(spark, root)).collect()
    with pytest.raises(ValueError, match="would mix"):
        persist_and_roll(root, run="two")(posts, 0)
    assert sorted(map(str, comparable(read_rollup(spark, root)).collect())) == sorted(map(str, before))
    persist_and_roll(root, run="two", adopt=True)(posts, 0)
    assert same_rows(comparable(read_rollup(spark, root)), comparable(rollup_5m(posts)))
    rebuilt = rebuild_from_tables(spark, root)
    assert same_rows(comparable(rebuilt), comparable(rollup_5m(posts)))


def test_copies_of_a_post_are_picked_in_a_total_order(spark, tmp_path):
    root = str(tmp_path / "out")
    posts = sample(spark, 20)
    changed = posts.withColumn("author", F.lit("other")).withColumn("created_at", F.col("created_at") + F.expr("interval 1 second"))
    for first, second in ((posts, changed), (changed, posts)):
        persist_and_roll(root, run="r")(first.unionByName(second).repartition(5), 0)
        rows = read_table(spark, root, RAW_TABLE)
        assert rows.count() == 20 and not rows.where("author = 'other'").count()


def test_quarantine_of_streams_and_backlog(spark, tmp_path):
    topic, bad = str(tmp_path / "raw"), str(tmp_path / "bad")
    write_raw_posts(spark.createDataFrame(RAW_ROWS, RAW_POST), topic)
    lines = ['{"source": "news", "post_id": "m", "created_at": "garbage", "text": "x"}', "{broken"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.mode("append").text(topic)
    stream = enrich_stream(
        read_raw_posts(spark, topic, streaming=True), scorers(), ["AA"], quarantine=bad, trigger=NOW
    )
    write_enriched_posts(stream, str(tmp_path / "enriched"), str(tmp_path / "cp"), NOW).awaitTermination()
    for query in spark.streams.active:
        query.awaitTermination()
    errors = {r.post_id: r.errors for r in spark.read.json(bad).collect()}
    assert errors["m"] == ["created_at malformed"] and errors["e"] == ["text empty"] and len(errors) == 3
    rest = str(tmp_path / "bad2")
    enrich_backlog(read_raw_posts(spark, topic), scorers(), ["AA"], quarantine=rest).collect()
    assert spark.read.json(rest).count() == 3
    wrong = sample(spark, 6).withColumn("conviction", F.lit(2.0))
    write_parts(wrong, tmp_path / "in", 1)
    start_rollup(
        stream_of(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp3"), trigger=NOW, quarantine=str(tmp_path / "bad3")
    ).awaitTermination()
    assert spark.read.json(str(tmp_path / "bad3")).count() == 6


def test_large_allowlist_on_a_stream(spark, tmp_path):
    rows = [("reddit", "a", "buy AA and BB, AA"), (None, None, "see BB")]
    schema = "source string, post_id string, text string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = extract_tickers(stream, "text", ["AA", "BB"], literal_limit=1)
    run_dedup(found, tmp_path).awaitTermination()
    got = {r.text: r.tickers for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {"buy AA and BB, AA": ["AA", "BB"], "see BB": ["BB"]}
