from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import VariantVal

from helpers import enriched, same_rows
from tickertide.operators.cursors import (
    advance_cursor,
    cap_oldest,
    merge_cursors,
    newest_per_batch,
    news_cursor,
    oldest_first,
    since_cursor,
    since_watermark,
    social_cursor,
)
from tickertide.operators.validate import validate_raw
from tickertide.plans.load import load_news, read_cursors
from tickertide.schema import CURSORS, ENRICHED_POST, RAW_POST
from tickertide.sources.payloads import news_to_raw, read_news_responses, read_social_items, social_to_raw
from tickertide.sources.symbols import build_symbols, parse_symbol_lines, read_allowlist, read_symbol_directory, write_symbols
from tickertide.sources.topics import from_wire, read_enriched_posts, read_raw_posts, to_wire, write_enriched_posts, write_raw_posts

DAY = datetime(2024, 1, 1)


def plain(meta):
    return {k: v.toPython() for k, v in meta.items()}


def sha24(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def test_social_payload(spark, tmp_path):
    items = [
        {"fullname": "t3_a", "created_utc": 1704067200.25, "author": "ann", "title": "Hi", "selftext": " body\n", "url": "http://u", "permalink": "/r/x/a", "score": 3, "num_comments": 1, "subreddit": " x "},
        {"fullname": "t3_b", "created_utc": 1704067260, "title": " only title ", "permalink": "/r/x/b", "subreddit": "x"},
    ]
    path = tmp_path / "s.json"
    path.write_text("\n".join(map(json.dumps, items)))
    a, b = social_to_raw(read_social_items(spark, str(path))).orderBy("post_id").collect()
    assert (a.source, a.post_id, a.author, a.text, a.url) == ("reddit", "t3_a", "ann", "Hi\n\n body", "http://u")
    assert a.created_at == DAY + timedelta(milliseconds=250)
    assert plain(a.meta) == {"subreddit": "x", "permalink": "https://www.reddit.com/r/x/a", "score": 3, "num_comments": 1}
    assert b.meta["score"] is None
    assert (b.author, b.text, b.url) == (None, "only title", None)


def test_news_payload(spark, tmp_path):
    articles = [
        {"source": {"name": " Wire "}, "author": "", "title": " T ", "description": None, "content": "\tC ", "url": " http://n ", "publishedAt": "2024-01-01T00:00:00Z"},
        {"source": None, "author": " ", "title": "Only", "description": " ", "content": "", "url": "", "publishedAt": "2024-01-01T02:00:00+02:00"},
        {"title": "undated", "publishedAt": None},
        {"title": "undated", "publishedAt": ""},
        {"title": None, "url": None, "publishedAt": "2024-01-01T01:00:00"},
    ]
    path = tmp_path / "n.json"
    path.write_text(json.dumps({"query": " q ", "articles": articles}) + "\n" + json.dumps({"query": "none", "articles": None}))
    rows = {r.post_id: r for r in news_to_raw(read_news_responses(spark, str(path))).collect()}
    assert len(rows) == 3
    a = rows["news_" + sha24("http://n|2024-01-01T00:00:00Z")]
    assert (a.source, a.author, a.text, a.url, a.created_at) == ("news", None, "T\n\nC", "http://n", DAY)
    assert plain(a.meta) == {"query": "q", "source_name": "Wire"}
    b = rows["news_" + sha24("title:Only|2024-01-01T02:00:00+02:00")]
    assert (b.author, b.text, b.url, b.created_at) == (" ", "Only", None, DAY)
    c = rows["news_" + sha24("title:|2024-01-01T01:00:00")]
    assert (c.text, c.created_at) == ("", DAY + timedelta(hours=1))


def test_malformed_news_times_reach_the_quarantine_once(spark, tmp_path):
    topic, cursors = str(tmp_path / "topic"), str(tmp_path / "cursors")
    times = ["2024-01-01T00:00:00Z", "soon", "2024-01-01T01:00:00Z", "2024-13-45T00:00:00Z", " ", ""]
    articles = [{"title": f"t{i}", "url": f"http://n/{i}", "publishedAt": t} for i, t in enumerate(times)]
    late = [{"title": "t9", "url": "http://n/9", "publishedAt": "01/02/2024 at noon"}]
    for hour, (found, oldest) in enumerate(((articles, 1), (articles, None), (articles + late, None), (late, 1))):
        path = tmp_path / f"n{hour}.json"
        path.write_text(json.dumps({"query": "q", "articles": found}))
        load_news(read_news_responses(spark, str(path)), topic, cursors, DAY + timedelta(days=1, hours=hour), oldest)
    good, bad = validate_raw(read_raw_posts(spark, topic))
    assert sorted((r.text, r.created_at) for r in good.collect()) == [("t0", DAY), ("t2", DAY + timedelta(hours=1))]
    assert sorted((r.text, *r.errors) for r in bad.collect()) == [(t, "created_at malformed") for t in ("t1", "t3", "t9")]
    messages = [json.loads(r.value) for r in spark.read.text(topic).collect()]
    assert {m["text"]: m["created_at"] for m in messages}["t1"] == "soon"
    assert {r.stream_id: r.cursor for r in read_cursors(spark, cursors).collect()}["news:default"] == "2024-01-01T01:00:00Z"


def test_equal_listing_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([(x,) for x in ["AA|N|N", "AA|N|N", "AA|N|Y", "BB|N|N"] * 3], "value string")
    header = "Symbol|Test Issue|ETF"
    parsed = parse_symbol_lines(lines, header, "Symbol", unique=True)
    assert sorted(r.symbol for r in parsed.collect()) == ["AA", "BB"]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("split(") < plan.index("Aggregate")  # above it: on distinct lines
    assert parse_symbol_lines(lines, header, "Symbol").count() == 9


def test_symbols_are_looked_for_once_in_a_text(spark):
    from registry.queries import q_build_symbols

    plan = q_build_symbols(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # one for each listing


def test_symbols(spark, tmp_path):
    nasdaq = tmp_path / "nasdaq.txt"
    nasdaq.write_text(
        "\nSymbol|Name|Test Issue|ETF\naapl |Apple|N|N\nQQQ|Fund|N|Y\nTEST|T|Y|N\nBAD|row\n |none|N|N\nLONGER|x|N|N\nFile Creation Time: 1|||\n"
    )
    other = tmp_path / "other.txt"
    other.write_text("ACT Symbol|Name\nBRK.B|Berkshire\nGE|General\nAAPL|again\n")
    first = read_symbol_directory(spark, str(nasdaq), "Symbol")
    assert sorted(r.symbol for r in first.collect()) == ["AAPL", "LONGER"]
    with_etfs = read_symbol_directory(spark, str(nasdaq), "Symbol", include_etfs=True)
    second = read_symbol_directory(spark, str(other), "ACT Symbol")
    assert [r.symbol for r in build_symbols(first, second).collect()] == ["AAPL", "GE"]
    assert [r.symbol for r in build_symbols(with_etfs, second).collect()] == ["AAPL", "GE", "QQQ"]
    write_symbols(build_symbols(with_etfs, second), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == "AAPL\nGE\nQQQ\n"
    assert sorted(r.symbol for r in read_allowlist(spark, str(tmp_path / "out")).collect()) == ["AAPL", "GE", "QQQ"]


def test_allowlist_file(spark, tmp_path):
    path = tmp_path / "allow.txt"
    path.write_text("# note\n aapl\n\n\tGE \n#X\n")
    assert sorted(r.symbol for r in read_allowlist(spark, str(path)).collect()) == ["AAPL", "GE"]
    assert read_allowlist(spark, str(tmp_path / "absent.txt")) is None


def test_wire_round_trip_and_bad_messages(spark, tmp_path):
    raw = spark.createDataFrame(
        [("news", "a", DAY + timedelta(microseconds=5), None, "tëxt\n\"q\"", "", {"k": VariantVal.parseJson('{"n":[1,2.5,null],"s":"t"}')}), ("reddit", "b", DAY, "ann", "t", None, {})], RAW_POST
    )
    write_raw_posts(raw, str(tmp_path / "raw"))
    spark.createDataFrame([("not json",), ('{"source":"x","created_at":"2024-01-01T00:00:00","meta":{"n":1,"o":{"p":[true]}}}',)], "value string").write.mode("append").text(str(tmp_path / "raw"))
    back = read_raw_posts(spark, str(tmp_path / "raw"))
    assert back.columns == [*RAW_POST.fieldNames(), "bad_times"] and back.where("size(bad_times) > 0").isEmpty()
    assert same_rows(back.filter("post_id is not null").drop("meta", "bad_times"), raw.drop("meta"))
    naive = back.filter("source = 'x'").first()
    assert naive.created_at == DAY and plain(naive.meta) == {"n": 1, "o": {"p": [True]}}
    assert plain(back.filter("post_id = 'a'").first().meta) == {"k": {"n": [1, 2.5, None], "s": "t"}}
    assert back.filter("source is null").count() == 1
    message = json.loads(to_wire(raw).filter("key = 'a'").first().value)
    assert message["created_at"] == "2024-01-01T00:00:00.000005Z" and message["author"] is None
    posts = enriched(spark, [{"created_at": DAY, "enriched_at": DAY}, {"created_at": DAY, "emotions": {}, "tickers": []}])
    write_enriched_posts(posts, str(tmp_path / "enriched"))
    again = read_enriched_posts(spark, str(tmp_path / "enriched"))
    again = again.drop("bad_times")
    assert again.schema.simpleString() == ENRICHED_POST.simpleString()
    assert sorted(map(str, again.collect())) == sorted(map(str, posts.collect()))
    assert from_wire(to_wire(posts), ENRICHED_POST).count() == 2


LISTING = "subreddit string, post_id string, created_at timestamp"


def listing(spark):
    rows = [("x", f"x{i}", DAY + timedelta(minutes=i // 2)) for i in range(6)]
    return spark.createDataFrame(rows + [("y", "y0", DAY), ("y", "y1", DAY + timedelta(minutes=1))], LISTING)


def ids(df):
    return sorted(r.post_id for r in df.collect())


def test_since_cursor(spark):
    order = ["created_at", "post_id"]
    known = spark.createDataFrame([("x", "x3"), ("y", "gone")], "subreddit string, cursor string")
    fresh = since_cursor(listing(spark), known, "subreddit", "post_id", order)
    assert ids(fresh) == ["x4", "x5", "y0", "y1"]  # an absent cursor re-emits the batch
    assert [r.post_id for r in oldest_first(fresh.filter("subreddit = 'x'"), order).collect()] == ["x4", "x5"]
    newest = spark.createDataFrame([("x", "x5")], "subreddit string, cursor string")
    assert ids(since_cursor(listing(spark), newest, "subreddit", "post_id", order)) == ["y0", "y1"]


def test_newest_watermark_and_cap(spark):
    df = listing(spark)
    assert ids(newest_per_batch(df, "subreddit", ["created_at", "post_id"], 2)) == ["x4", "x5", "y0", "y1"]
    assert ids(since_watermark(df, "created_at", DAY + timedelta(minutes=1))) == ["x4", "x5"]  # strictly later
    with_null = df.unionByName(spark.createDataFrame([("z", "z0", None)], LISTING))
    assert ids(since_watermark(with_null, "created_at", None)) == ids(df)
    assert ids(cap_oldest(df, "created_at", ["post_id"], 3)) == ["x0", "x1", "y0"]


def test_advance_and_merge_cursors(spark):
    got = {r.stream_id: r.cursor for r in social_cursor(listing(spark)).collect()}
    assert got == {"reddit:x": "x5", "reddit:y": "y1"}
    frac = listing(spark).withColumn("created_at", F.col("created_at") + F.expr("interval 5 microsecond"))
    assert news_cursor(frac).first().cursor == "2024-01-01T00:02:00.000005Z"
    assert news_cursor(listing(spark), "news:ai").first().asDict() == {"source": "news", "stream_id": "news:ai", "cursor": "2024-01-01T00:02:00Z"}
    assert news_cursor(listing(spark).limit(0)).isEmpty()
    assert advance_cursor(listing(spark), F.lit("all"), ["created_at", "post_id"], F.col("post_id")).first().cursor == "x5"
    store = spark.createDataFrame([("reddit", "a", "1", DAY), ("reddit", "b", "1", DAY)], CURSORS)
    updates = spark.createDataFrame([("reddit", "a", "2", DAY + timedelta(1)), ("news", "c", "3", DAY), ("reddit", "b", "9", DAY)], CURSORS)
    merged = {(r.source, r.stream_id): r.cursor for r in merge_cursors(store, updates).collect()}
    assert merged == {("reddit", "a"): "2", ("reddit", "b"): "9", ("news", "c"): "3"}
