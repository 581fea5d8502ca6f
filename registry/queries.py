"""Every implemented query and operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from registry import fixtures as fx
from tickertide.functions.sentiment import (
    conviction,
    emotion_map,
    sentiment_from_probs,
    source_weight,
    stance_from_probs,
)
from tickertide.functions.quality import quality_flags
from tickertide.functions.text import (
    author_key,
    dedup_key,
    drop_stop_tokens,
    keep_allowed,
    normalize_text,
    ordered_distinct,
    ticker_candidates,
)
from tickertide.functions.time import between, floor_5m, iso_z, parse_iso_utc
from tickertide.operators.authors import (
    author_bitmaps,
    count_bitmaps,
    merge_bitmaps,
    number_authors,
    widen_bitmaps,
)
from tickertide.operators.cursors import (
    cap_oldest,
    merge_cursors,
    newest_per_batch,
    news_cursor,
    since_cursor,
    since_watermark,
    social_cursor,
)
from tickertide.operators.dedup import dedup_batch_ttl
from tickertide.operators.merge import insert_if_absent
from tickertide.operators.rollup import (
    explode_mentions,
    mention_authors,
    merge_rollup,
    rollup_5m,
    rollup_to,
    sum_maps,
    unique_authors,
)
from tickertide.operators.scoring import score_posts
from tickertide.operators.tickers import extract_tickers
from tickertide.operators.validate import has_ticker, validate_enriched, validate_raw
from tickertide.plans import ranking
from tickertide.plans.backfill import (
    enrich_backlog,
    read_recomputed,
    rebuild_from_tables,
    recompute_touched,
    touched_hours,
)
from tickertide.plans.load import load_news, load_social
from tickertide.schema import ENRICHED_POST, RAW_POST
from tickertide.session import ROCKSDB_PROVIDER, scratch_dir
from tickertide.session import stage_table
from tickertide.sources.payloads import news_articles, news_post_id, news_to_raw, social_to_raw
from tickertide.sources.symbols import build_symbols, parse_symbol_lines, read_allowlist, write_symbols
from tickertide.sources.tables import ENRICHED_TABLE, RAW_TABLE, read_rollup, read_table
from tickertide.sources.topics import (
    from_wire,
    read_enriched_posts,
    read_raw_posts,
    to_wire,
    write_enriched_posts,
    write_raw_posts,
)
from tickertide.streaming.dedup import dedup_stream_event_time, dedup_stream_ttl
from tickertide.streaming.enrich import start_arrivals, start_enrich
from tickertide.streaming.rollup import persist_and_roll, rollup_stream, start_rollup

Query = Callable[[SparkSession, str], DataFrame]


def _clock(name: Column | str) -> Column:
    """A UTC instant as a zone-less timestamp, comparable across engines."""
    return (F.col(name) if isinstance(name, str) else name).cast("timestamp_ntz")


def _joined(array: Column | str) -> Column:
    return F.array_join(array, ",")


def _flat_rollup(df: DataFrame, authors: bool = True) -> DataFrame:
    """A rollup with rounded sums and its emotion map as text."""
    pairs = F.transform(
        F.array_sort(F.map_entries("emotion_sums")),
        lambda e: F.concat(e["key"], F.lit("="), (e["value"] * 16).cast("long").cast("string")),
    )
    return df.select(
        _clock("bucket_start").alias("bucket_start"),
        "ticker",
        "mention_count",
        F.round("weighted_mentions", 9).alias("weighted_mentions"),
        *(["unique_authors"] if authors else []),
        "news_count",
        "reddit_count",
        F.round("sentiment_sum", 9).alias("sentiment_sum"),
        "sentiment_count",
        "bullish_count",
        "bearish_count",
        "neutral_count",
        F.round("conviction_sum", 9).alias("conviction_sum"),
        _joined(pairs).alias("emotion_sums"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(f.name, 6).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _rollup(spark, sf) -> DataFrame:
    return rollup_5m(fx.enriched(spark, sf))


def _event_rollup(spark, sf) -> DataFrame:
    return rollup_5m(fx.event_posts(fx.events(spark, sf)))


# --- text and score columns ----------------------------------------------------


def q_normalize_text(spark, sf):
    return fx.posts(spark, sf).select("post_id", normalize_text("text").alias("norm"))


def q_dedup_key(spark, sf):
    return fx.posts(spark, sf).select("post_id", dedup_key("url", "text").alias("dedup_key"))


def q_author_key(spark, sf):
    return fx.posts(spark, sf).select("post_id", author_key("source", "author").alias("author_key"))


def q_ticker_candidates(spark, sf):
    return fx.posts(spark, sf).select("post_id", _joined(ticker_candidates("text")).alias("found"))


def q_drop_stop_tokens(spark, sf):
    kept = drop_stop_tokens(ticker_candidates("text"))
    return fx.posts(spark, sf).select("post_id", _joined(kept).alias("found"))


def q_ordered_distinct(spark, sf):
    return fx.posts(spark, sf).select(
        "post_id", _joined(ordered_distinct(ticker_candidates("text"))).alias("found")
    )


def q_keep_allowed(spark, sf):
    return fx.posts(spark, sf).select(
        "post_id", _joined(keep_allowed(ticker_candidates("text"), fx.ALLOW)).alias("found")
    )


def q_extract_tickers(spark, sf):
    found = extract_tickers(fx.posts(spark, sf), "text", fx.ALLOW)
    return found.select("post_id", _joined("tickers").alias("tickers"))


def q_extract_tickers_join(spark, sf):
    found = extract_tickers(fx.posts(spark, sf), "text", fx.ALLOW, literal_limit=0)
    return found.select("post_id", _joined("tickers").alias("tickers"))


def q_extract_tickers_open(spark, sf):
    found = extract_tickers(fx.posts(spark, sf), "text", None)
    return found.select("post_id", _joined("tickers").alias("tickers"))


def q_quality_flags(spark, sf):
    found = extract_tickers(fx.posts(spark, sf), "text", fx.ALLOW)
    return found.select("post_id", _joined(quality_flags("tickers", "text")).alias("flags"))


def q_source_weight(spark, sf):
    return fx.posts(spark, sf).select("post_id", source_weight("source").alias("source_weight"))


def q_sentiment_from_probs(spark, sf):
    return fx.posts(spark, sf).select(
        "post_id", sentiment_from_probs("scores.finance").alias("s")
    ).select("post_id", "s.pos", "s.neg", "s.neutral", "s.score")


def q_emotion_map(spark, sf):
    pairs = F.map_entries("scores.emotion")
    flat = fx.posts(spark, sf).select("post_id", F.explode(emotion_map(pairs)).alias("label", "p"))
    return flat


def q_stance_from_probs(spark, sf):
    stance = fx.posts(spark, sf).select("post_id", stance_from_probs(fx.stance_map()).alias("s"))
    return stance.select("post_id", "s.label", "s.confidence", F.size("s.probs").cast("long").alias("n"))


def q_conviction(spark, sf):
    scored = fx.posts(spark, sf).select(
        "post_id",
        sentiment_from_probs("scores.finance").alias("f"),
        stance_from_probs("scores.stance").alias("s"),
    )
    value = conviction(F.col("s.label"), F.col("s.confidence"), F.col("f.score"))
    return scored.select("post_id", F.round(value, 9).alias("conviction"))


def q_enrich(spark, sf):
    return fx.enriched(spark, sf).select(
        "source",
        "post_id",
        _clock("created_at").alias("created_at"),
        "author",
        "text",
        "url",
        _joined("tickers").alias("tickers"),
        "language",
        "finbert_pos",
        "finbert_neg",
        "finbert_neutral",
        "finbert_score",
        F.size("emotions").cast("long").alias("n_emotions"),
        F.coalesce(F.col("emotions")["joy"], F.lit(0.0)).alias("joy"),
        "stance_label",
        "stance_confidence",
        F.round("conviction", 9).alias("conviction"),
        "source_weight",
        "dedup_key",
        "confidence",
        _joined("flags").alias("flags"),
    )


def q_score_posts(spark, sf):
    scored = score_posts(fx.posts(spark, sf).drop("scores"), fx.length_scorers())
    fin, st = sentiment_from_probs("scores.finance"), stance_from_probs("scores.stance")
    return scored.select("post_id", fin.alias("f"), st.alias("s"), "scores").select(
        "post_id",
        "f.score",
        "s.label",
        "s.confidence",
        F.coalesce(F.col("scores.emotion")["joy"], F.lit(-1.0)).alias("joy"),
    )


# --- times ----------------------------------------------------------------------


def q_floor_5m(spark, sf):
    stamps = fx.events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return stamps.select("event_id", _clock(floor_5m("ts")).alias("bucket_start"))


def q_parse_iso_utc(spark, sf):
    stamped = news_articles(fx.news_responses(spark, sf))
    return stamped.select("title", _clock(parse_iso_utc("published")).alias("published_at"))


def q_iso_z(spark, sf):
    stamps = fx.events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return stamps.select("event_id", iso_z("ts").alias("iso"))


def q_time_range(spark, sf):
    rows = _event_rollup(spark, sf)
    inside = rows.filter(between("bucket_start", "2024-01-05", "2024-01-20T12:00:00"))
    return inside.select(_clock("bucket_start").alias("bucket_start"), "ticker", "mention_count")


# --- sources --------------------------------------------------------------------


def q_social_to_raw(spark, sf):
    raw = social_to_raw(fx.social_items(spark, sf))
    return raw.select(
        "source",
        "post_id",
        _clock("created_at").alias("created_at"),
        "author",
        "text",
        "url",
        F.col("meta")["subreddit"].cast("string").alias("subreddit"),
        F.col("meta")["permalink"].cast("string").alias("permalink"),
        F.col("meta")["score"].cast("long").alias("score"),
        F.col("meta")["num_comments"].cast("long").alias("num_comments"),
    )


def q_news_to_raw(spark, sf):
    raw = news_to_raw(fx.news_responses(spark, sf))
    return raw.select(
        "source",
        "post_id",
        _clock("created_at").alias("created_at"),
        "author",
        "text",
        "url",
        F.col("meta")["query"].cast("string").alias("query"),
        F.col("meta")["source_name"].cast("string").alias("source_name"),
    )


def q_news_post_id(spark, sf):
    articles = news_articles(fx.news_responses(spark, sf))
    return articles.select("title", news_post_id("url", "title", "published").alias("post_id"))


def q_raw_wire(spark, sf):
    """Encode to JSON messages and decode again."""
    raw = fx.posts(spark, sf).select(*RAW_POST.fieldNames())
    back = from_wire(to_wire(raw), RAW_POST)
    return back.select(
        "source", "post_id", _clock("created_at").alias("created_at"), "author", "text", "url",
        F.col("meta")["lang"].cast("string").alias("lang"),
        F.variant_get(F.col("meta")["place"], "$.row", "long").alias("place_row"),
        F.variant_get(F.col("meta")["place"], "$.share", "double").alias("place_share"),
        F.variant_get(F.col("meta")["place"], "$.path[1]", "string").alias("place_second"),
        F.col("meta")["even"].cast("boolean").alias("even"),
    )


def q_enriched_wire(spark, sf):
    back = from_wire(to_wire(fx.enriched(spark, sf)), ENRICHED_POST)
    return back.select(
        "source", "post_id", _clock("created_at").alias("created_at"), "text",
        _joined("tickers").alias("tickers"), "finbert_score", "stance_label",
        F.round("conviction", 9).alias("conviction"),
        F.size("emotions").cast("long").alias("n_emotions"), "source_weight",
    )


def _listing(spark, sf, symbol_col: str) -> tuple[DataFrame, str]:
    """Listing lines made from the tickers of the documents."""
    header = f"{symbol_col}|Test Issue|ETF"
    # Wrapped, so that no filter is inferred from the explode: it would find the tickers again.
    words = fx.posts(spark, sf).select("doc_id", F.explode(F.array_compact(ticker_candidates("text"))).alias("s"))
    if symbol_col == "Symbol":
        words = words.withColumn("s", F.concat(F.lit(" "), F.lower("s")))
    else:
        words = words.withColumn("s", F.concat("s", F.when(F.col("doc_id") % 4 == 0, ".B").otherwise("")))
    flags = [
        F.when(F.col("doc_id") % 10 == 7, "Y").otherwise("N"),
        F.when(F.col("doc_id") % 6 == 2, "Y").otherwise("N"),
    ]
    wide = F.when(F.col("doc_id") % 9 == 4, "|extra").otherwise("")
    return words.select(F.concat(F.concat_ws("|", "s", *flags), wide).alias("value")), header


def q_build_symbols(spark, sf):
    first = parse_symbol_lines(*_listing(spark, sf, "Symbol"), "Symbol", unique=True)
    other = parse_symbol_lines(*_listing(spark, sf, "ACT Symbol"), "ACT Symbol", unique=True)
    return build_symbols(first, other)


def q_validate_raw(spark, sf):
    broken = fx.posts(spark, sf).withColumns(
        {
            "text": F.when(F.col("doc_id") % 7 == 3, "").otherwise(F.col("text")),
            "source": F.when(F.col("doc_id") % 8 != 5, F.col("source")),
            "created_at": F.when(F.col("doc_id") % 4 != 1, F.col("created_at")),
        }
    )
    good, bad = validate_raw(broken, now=F.timestamp_seconds(F.lit(fx.MIDNIGHT)))
    good = good.select("post_id", _clock("created_at").alias("created_at"), F.lit("").alias("errors"))
    bad = bad.select("post_id", _clock("created_at").alias("created_at"), _joined("errors").alias("errors"))
    return good.unionByName(bad)


def q_validate_enriched(spark, sf):
    broken = fx.enriched(spark, sf).withColumns(
        {
            "finbert_score": F.col("finbert_score") * 3,
            "stance_confidence": F.when(F.col("stance_confidence") < 0.9, F.col("stance_confidence")),
            "source_weight": F.when(F.col("source") == "reddit", F.col("source_weight")),
        }
    )
    good, bad = validate_enriched(broken)
    good = good.select("post_id", "stance_confidence", "source_weight", F.lit("").alias("errors"))
    bad = bad.select("post_id", "stance_confidence", "source_weight", _joined("errors").alias("errors"))
    return good.unionByName(bad)


# --- rollup ---------------------------------------------------------------------


def q_explode_mentions(spark, sf):
    mentions = explode_mentions(fx.enriched(spark, sf))
    return mentions.select("source", "post_id", "ticker", "finbert_score", "source_weight")


def q_rollup_5m(spark, sf):
    return _flat_rollup(_rollup(spark, sf))


def q_rollup_5m_events(spark, sf):
    return _flat_rollup(_event_rollup(spark, sf))


def q_emotion_sums(spark, sf):
    mentions = explode_mentions(fx.enriched(spark, sf)).withColumn("bucket_start", floor_5m("created_at"))
    sums = sum_maps(mentions, ["bucket_start", "ticker"], "emotions")
    flat = sums.select("bucket_start", "ticker", F.explode_outer("emotions").alias("label", "total"))
    return flat.withColumn("bucket_start", _clock("bucket_start"))


def _author_bitmaps(spark, sf) -> DataFrame:
    """Bitmaps of two batches, the second with authors that the first didn't have."""
    posts = fx.event_posts(fx.events(spark, sf)).withColumn("early", F.col("created_at") < "2024-01-11")
    first, second = (mention_authors(posts.where(c)) for c in ("early", "not early"))
    numbers = stage_table(number_authors(first), "authors-first")
    more = stage_table(number_authors(second, numbers), "authors-second")
    return merge_bitmaps(author_bitmaps(first, numbers), author_bitmaps(second, more))


def q_unique_authors_hour(spark, sf):
    counts = count_bitmaps(widen_bitmaps(_author_bitmaps(spark, sf), "1 hour"))
    return counts.select(_clock("bucket_start").alias("bucket_start"), "ticker", "unique_authors")


def q_rollup_day_authors(spark, sf):
    """Daily rows from five-minute rows and their bitmaps; the posts are not read again."""
    days = rollup_to(_event_rollup(spark, sf), "1 day", _author_bitmaps(spark, sf))
    return days.select(_clock("bucket_start").alias("bucket_start"), "ticker", "mention_count", "unique_authors")


def q_unique_authors(spark, sf):
    counts = unique_authors(fx.enriched(spark, sf))
    return counts.withColumn("bucket_start", _clock("bucket_start"))


def q_rollup_to_hour(spark, sf):
    return _flat_rollup(rollup_to(_rollup(spark, sf), "1 hour"), authors=False)


def q_merge_rollup(spark, sf):
    """Two halves merged equal the whole, distinct authors included."""
    posts = fx.enriched(spark, sf)
    early = F.pmod(F.xxhash64("post_id"), F.lit(2)) == 0
    target = rollup_5m(posts.filter(early))
    delta = rollup_5m(posts.filter(~early), known_authors=mention_authors(posts.filter(early)))
    return _flat_rollup(merge_rollup(target, delta))


def q_insert_if_absent(spark, sf):
    """Posts delivered twice, against the stored news posts."""
    posts = fx.posts(spark, sf).select("source", "post_id", "doc_id", F.length("text").alias("n"))
    again = posts.withColumn("n", F.col("n") + 1)
    batch = posts.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(0)))
    stored = posts.filter("source = 'news'")
    fresh = insert_if_absent(stored, batch, ["source", "post_id"], order_by=["seq"])
    return fresh.select("source", "post_id", F.col("n").cast("long").alias("n"))


# --- rankings -------------------------------------------------------------------


def q_trending_api(spark, sf):
    return _rounded(ranking.trending_api(_rollup(spark, sf), fx.AS_OF, minutes=600))


def q_trending_web(spark, sf):
    return _rounded(ranking.trending_web(_rollup(spark, sf), fx.AS_OF, minutes=600))


def q_movers_api(spark, sf):
    return _rounded(ranking.movers_api(_rollup(spark, sf), fx.AS_OF, window_minutes=240))


def q_movers_api_join(spark, sf):
    return _rounded(
        ranking.movers_api(_rollup(spark, sf), fx.AS_OF, window_minutes=240, single_scan=False)
    )


def q_movers_api_cross(spark, sf):
    return _rounded(
        ranking.movers_api(
            _rollup(spark, sf), fx.AS_OF, window_minutes=240, limit=15, require_cross_source=True
        )
    )


def q_movers_web(spark, sf):
    return _rounded(ranking.movers_web(_rollup(spark, sf), fx.AS_OF, window_minutes=240))


def q_movers_web_join(spark, sf):
    return _rounded(
        ranking.movers_web(_rollup(spark, sf), fx.AS_OF, window_minutes=240, single_scan=False)
    )


def q_movers_web_cross(spark, sf):
    return _rounded(
        ranking.movers_web(
            _rollup(spark, sf), fx.AS_OF, window_minutes=240, limit=15, require_cross_source=True
        )
    )


def q_movers_single_scan(spark, sf):
    return _rounded(
        ranking.movers_api(
            _event_rollup(spark, sf), "2024-01-20", window_minutes=360, baseline_hours=72
        )
    )


# --- cursors --------------------------------------------------------------------


def _social(spark, sf) -> DataFrame:
    raw = social_to_raw(fx.social_items(spark, sf))
    return raw.withColumn("subreddit", F.col("meta")["subreddit"].cast("string"))


def _brief(df: DataFrame) -> DataFrame:
    return df.select("subreddit", "post_id", _clock("created_at").alias("created_at"))


def q_since_cursor(spark, sf):
    social = _social(spark, sf)
    # Subreddits 0-2 have a known cursor, 3 an unknown one, 4 none.
    cursors = (
        social.groupBy("subreddit")
        .agg(F.max_by("post_id", F.struct((F.abs(F.unix_micros("created_at") - (fx.MIDNIGHT + 43200) * 1_000_000) * -1), "post_id")).alias("cursor"))
        .filter("subreddit <> 'sub4'")
        .withColumn("cursor", F.when(F.col("subreddit") == "sub3", "gone").otherwise(F.col("cursor")))
    )
    return _brief(since_cursor(social, cursors, "subreddit", "post_id", ["created_at", "post_id"]))


def q_newest_per_batch(spark, sf):
    return _brief(newest_per_batch(_social(spark, sf), "subreddit", ["created_at", "post_id"], 10))


def q_since_watermark(spark, sf):
    news = news_to_raw(fx.news_responses(spark, sf))
    later = since_watermark(news, "created_at", datetime(2024, 1, 1, 12))
    return later.select("post_id", _clock("created_at").alias("created_at"))


def q_cap_oldest(spark, sf):
    news = news_to_raw(fx.news_responses(spark, sf))
    oldest = cap_oldest(news, "created_at", ["post_id"], 50)
    return oldest.select("post_id", _clock("created_at").alias("created_at"))


def q_advance_cursor(spark, sf):
    news = news_to_raw(fx.news_responses(spark, sf))
    return social_cursor(_social(spark, sf)).unionByName(news_cursor(news))


def q_merge_cursors(spark, sf):
    ev = fx.events(spark, sf).select(
        F.lit("reddit").alias("source"),
        F.concat(F.lit("reddit:"), "event_type").alias("stream_id"),
        F.col("event_id").cast("string").alias("cursor"),
        F.col("ts").cast("timestamp").alias("updated_at"),
    )
    store = ev.filter("stream_id <> 'reddit:click'")
    updates = ev.withColumn("updated_at", F.col("updated_at") + F.expr("interval 1 second"))
    merged = merge_cursors(store, updates)
    return merged.withColumn("updated_at", _clock("updated_at"))


# --- dedup and streams ----------------------------------------------------------


def q_dedup_batch_ttl(spark, sf):
    posts = fx.event_posts(fx.events(spark, sf))
    kept = dedup_batch_ttl(posts, "dedup_key", "created_at", ["post_id"], ttl_seconds=36000)
    return kept.select("post_id", "dedup_key", _clock("created_at").alias("created_at"))


def q_dedup_batch_ttl_hot(spark, sf):
    """The same rule by event type alone: every key takes the pointer-doubling way."""
    posts = fx.event_posts(fx.events(spark, sf)).withColumn("kind", F.col("tickers")[0])
    kept = dedup_batch_ttl(posts, "kind", "created_at", ["post_id"], ttl_seconds=36000, hot_rows=100)
    return kept.select("post_id", "kind", _clock("created_at").alias("created_at"))


def _event_stream(spark, sf) -> DataFrame:
    schema = fx.events(spark, sf).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return source.parquet(sf)


def q_stream_rollup(spark, sf):
    root, checkpoint = scratch_dir(spark, "rollup"), scratch_dir(spark, "rollup-offsets")
    fields = {f.name: f for f in ENRICHED_POST.fields}
    posts = fx.event_posts(_event_stream(spark, sf)).withColumn("text", F.lit("-"))
    for name in fields.keys() - set(posts.columns):
        posts = posts.withColumn(name, F.lit(None).cast(fields[name].dataType))
    query = start_rollup(posts, root, checkpoint, trigger={"availableNow": True})
    query.awaitTermination()
    return _flat_rollup(read_rollup(spark, root))


STREAM_FILES = 4


def q_stream_dedup(spark, sf, files: int = STREAM_FILES):
    """The time-to-live rule on a stream that arrives in several micro-batches."""
    posts = fx.event_posts(fx.events(spark, sf)).select("source", "post_id", "dedup_key", "created_at")
    folder, out, offsets = (scratch_dir(spark, n) for n in ("events", "dedup", "dedup-offsets"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    for span in _spans(posts, files):
        posts.where(span).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(posts.schema).parquet(folder)
        fresh = dedup_stream_event_time(stream, ids=("post_id",))
        (
            fresh.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", offsets)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    kept = spark.read.schema(posts.schema).parquet(out)
    return kept.select("post_id", "dedup_key", _clock("created_at").alias("created_at"))


def _spans(posts: DataFrame, files: int) -> list[Column]:
    """Equal spans of creation time, one after the other."""
    first, last = posts.agg(F.min(F.unix_micros("created_at")), F.max(F.unix_micros("created_at"))).first()
    width = (last - first) // files + 1
    return [F.floor((F.unix_micros("created_at") - first) / width) == number for number in range(files)]


CHAIN_FILES = 2


def q_stream_enrich(spark, sf):
    """Raw topic, arrivals, enriched topic, rollup: two chained jobs over files that arrive in turn."""
    posts = fx.posts(spark, sf).select(*RAW_POST.fieldNames())
    topic, arrived, enriched, root, *offsets = (
        scratch_dir(spark, n) for n in ("raw", "arrived", "enriched", "rolled", "offsets", "offsets", "offsets")
    )
    now = {"availableNow": True}
    for span in _spans(posts, CHAIN_FILES):
        write_raw_posts(posts.where(span), topic)
        raw = read_raw_posts(spark, topic, streaming=True)
        start_arrivals(raw, arrived, offsets[0], trigger=now).awaitTermination()
        start_enrich(
            spark, arrived, enriched, offsets[1], fx.length_scorers(), fx.ALLOW, trigger=now
        ).awaitTermination()
        fresh = read_enriched_posts(spark, enriched, streaming=True)
        start_rollup(fresh, root, offsets[2], trigger=now).awaitTermination()
    return _flat_rollup(read_rollup(spark, root))


def _drain(spark, stream, name: str, **confs) -> DataFrame:
    """Run a stream to its end and read what it wrote."""
    out, checkpoint = scratch_dir(spark, name), scratch_dir(spark, f"{name}-offsets")
    before = {key: spark.conf.get(key, None) for key in confs}
    for key, value in confs.items():
        spark.conf.set(key, value)
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(out)


def q_stream_rollup_bounded(spark, sf):
    """Append mode: the buckets an hour behind the latest event."""
    closed = rollup_stream(fx.event_posts(_event_stream(spark, sf)), "1 hour")
    return _flat_rollup(_drain(spark, closed, "bounded"))


def q_stream_dedup_ttl(spark, sf):
    fresh = dedup_stream_ttl(fx.event_posts(_event_stream(spark, sf)).select("dedup_key", "post_id"))
    kept = _drain(
        spark,
        fresh,
        "dedup-ttl",
        **{
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
            "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        },
    )
    return kept.select("dedup_key")


def q_backfill(spark, sf):
    """Validate, drop reposts, score and enrich a stored backlog."""
    done = enrich_backlog(fx.posts(spark, sf).drop("scores"), fx.length_scorers(), fx.ALLOW)
    return done.select(
        "source", "post_id", "dedup_key", _joined("tickers").alias("tickers"), "finbert_score", "stance_label"
    )


_stored: dict[tuple[str, str], str] = {}


def _batches(spark, sf) -> str:
    """The root of stored event posts, written once for a session and folder."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _stored:
        _stored[at] = _write_batches(spark, sf)
    return _stored[at]


def _write_batches(spark, sf) -> str:
    """Event posts stored in several micro-batches: redelivered ones, late ones, one replay."""
    root = scratch_dir(spark, "batches")
    fields = {f.name: f for f in ENRICHED_POST.fields}
    posts = fx.event_posts(fx.events(spark, sf)).withColumn("text", F.lit("-"))
    for name in fields.keys() - set(posts.columns):
        posts = posts.withColumn(name, F.lit(None).cast(fields[name].dataType))
    part = F.pmod(F.xxhash64("post_id"), F.lit(3))
    write = persist_and_roll(root, run="batches")
    write(posts.where(part == 0), 0)
    second = posts.where(part == 1).unionByName(posts.where((part == 0) & F.col("post_id").endswith("7")))
    write(second, 1)
    write(second, 1)
    write(posts.where(part == 2).unionByName(posts.where(F.col("post_id").endswith("3"))), 2)
    return root


def q_stream_rollup_batches(spark, sf):
    return _flat_rollup(read_rollup(spark, _batches(spark, sf)))


def q_stored_raw_posts(spark, sf):
    rows = read_table(spark, _batches(spark, sf), RAW_TABLE)
    return rows.select("source", "post_id", _clock("created_at").alias("created_at"), "author")


def q_stored_enriched_posts(spark, sf):
    rows = read_table(spark, _batches(spark, sf), ENRICHED_TABLE)
    return rows.select("source", "post_id", _joined("tickers").alias("tickers"), "stance_label", "conviction")


def q_rebuild_rollup(spark, sf):
    return _flat_rollup(rebuild_from_tables(spark, _batches(spark, sf)))


def q_recompute_late(spark, sf):
    """A table of final rows: all hours once, then just those that a late batch touches."""
    root = scratch_dir(spark, "late")
    fields = {f.name: f for f in ENRICHED_POST.fields}
    posts = fx.event_posts(fx.events(spark, sf)).withColumn("text", F.lit("-"))
    for name in fields.keys() - set(posts.columns):
        posts = posts.withColumn(name, F.lit(None).cast(fields[name].dataType))
    late = F.col("post_id").endswith("77")
    write = persist_and_roll(root, run="late")
    for batch_id, part in enumerate((posts.where(~late), posts.where(late))):
        write(part, batch_id)
        recompute_touched(spark, root, touched_hours(part))
    return _flat_rollup(read_recomputed(spark, root))


def q_stored_keys(spark, sf):
    """Posts that come again on another day, some before and some after their batch: each is stored once."""
    root = scratch_dir(spark, "keys")
    fields = {f.name: f for f in ENRICHED_POST.fields}
    posts = fx.event_posts(fx.events(spark, sf)).withColumn("text", F.lit("-"))
    for name in fields.keys() - set(posts.columns):
        posts = posts.withColumn(name, F.lit(None).cast(fields[name].dataType))
    later = posts.withColumn("created_at", F.col("created_at") + F.expr("interval 40 days"))
    write = persist_and_roll(root, run="keys")
    write(posts.where(~F.col("post_id").endswith("5")), 0)
    write(later.where(F.col("post_id").rlike("[13579]$")), 1)
    rows = read_table(spark, root, RAW_TABLE)
    return rows.select("source", "post_id", _clock("created_at").alias("created_at"), "author")


def q_trending_stored(spark, sf):
    return _rounded(ranking.trending_stored(spark, _batches(spark, sf), "2024-01-20", minutes=600))


def q_movers_api_stored(spark, sf):
    return _rounded(
        ranking.movers_api_stored(spark, _batches(spark, sf), "2024-01-20", window_minutes=360, baseline_hours=72)
    )


def q_movers_web_stored(spark, sf):
    return _rounded(ranking.movers_web_stored(spark, _batches(spark, sf), "2024-01-20", window_minutes=240))


def q_validate_wire(spark, sf):
    """Messages whose time is valid, absent or malformed, through a folder topic."""
    posts = fx.posts(spark, sf)
    d = F.col("doc_id")
    stamp = F.when(d % 3 == 0, iso_z("created_at")).when(d % 3 == 1, F.lit("soon"))
    message = F.to_json(F.struct("source", "post_id", stamp.alias("created_at"), "text"))
    topic = scratch_dir(spark, "wire")
    posts.select(message.alias("value")).write.text(topic)
    good, bad = validate_raw(read_raw_posts(spark, topic), now=F.timestamp_seconds(F.lit(fx.MIDNIGHT)))
    good = good.select("post_id", _clock("created_at").alias("created_at"), F.lit("").alias("errors"))
    bad = bad.select("post_id", _clock("created_at").alias("created_at"), _joined("errors").alias("errors"))
    return good.unionByName(bad)


def q_write_raw_topic(spark, sf):
    """Raw posts to a folder topic and back."""
    topic = scratch_dir(spark, "raw-topic")
    write_raw_posts(fx.posts(spark, sf).select(*RAW_POST.fieldNames()), topic)
    back = read_raw_posts(spark, topic)
    return back.select("source", "post_id", _clock("created_at").alias("created_at"), "author", "text", "url")


def q_write_enriched_topic(spark, sf):
    topic = scratch_dir(spark, "enriched-topic")
    write_enriched_posts(fx.enriched(spark, sf), topic)
    back = read_enriched_posts(spark, topic)
    return back.select("source", "post_id", _joined("tickers").alias("tickers"), "finbert_score", "stance_label")


def q_symbol_file(spark, sf):
    """The symbol list written and read again as an allowlist."""
    path = scratch_dir(spark, "symbols")
    write_symbols(q_build_symbols(spark, sf), path)
    return read_allowlist(spark, path)


def q_has_ticker(spark, sf):
    return fx.enriched(spark, sf).where(has_ticker()).select("post_id")


def _loaded(spark, topic: str) -> DataFrame:
    return read_raw_posts(spark, topic).select("source", "post_id", _clock("created_at").alias("created_at"))


def q_load_social(spark, sf):
    """Three loads: the items until noon, all of them, all again. Each comes through once."""
    items = fx.social_items(spark, sf)
    topic, cursors = scratch_dir(spark, "load-topic"), scratch_dir(spark, "load-cursors")
    for hour, landed in enumerate((items.where(F.col("created_utc") < fx.MIDNIGHT + 43200), items, items)):
        load_social(landed, topic, cursors, datetime(2024, 1, 2, hour))
    return _loaded(spark, topic)


def q_load_news(spark, sf):
    responses = fx.news_responses(spark, sf)
    topic, cursors = scratch_dir(spark, "load-topic"), scratch_dir(spark, "load-cursors")
    for hour, oldest in enumerate((100, 200, None, None)):
        load_news(responses, topic, cursors, datetime(2024, 1, 2, hour), oldest)
    return _loaded(spark, topic)


QUERIES: dict[str, Query] = {
    name.removeprefix("q_"): function
    for name, function in list(globals().items())
    if name.startswith("q_")
}
