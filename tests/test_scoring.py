from __future__ import annotations

import sys
import types
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import VariantVal

from tickertide.functions.sentiment import conviction, emotion_map, sentiment_from_probs, source_weight, stance_from_probs
from tickertide.operators.scoring import enrich, length_batches, score_posts
from tickertide.operators.validate import validate_enriched, validate_raw
from tickertide.schema import ENRICHED_POST, RAW_POST, STANCE_LABELS

from helpers import enriched

DAY = datetime(2024, 1, 1)
PROBS = "m map<string,double>"


def test_sentiment(spark):
    rows = [({"Positive": 0.75, "NEGATIVE": 0.25, "neutral": 0.5},), ({},), ({"positive": 3.0},), ({"negative": 2.0},)]
    got = spark.createDataFrame(rows, PROBS).select(sentiment_from_probs("m").alias("s")).collect()
    assert [tuple(r.s) for r in got] == [
        (0.75, 0.25, 0.5, 0.5), (0.0, 0.0, 0.0, 0.0), (3.0, 0.0, 0.0, 1.0), (0.0, 2.0, 0.0, -1.0),
    ]


def test_stance_ties_and_empty(spark):
    rows = [
        ({"Meme": 0.5, "BULLISH": 0.5, "neutral": 0.25},), ({},), ({"other": 0.9, "news": 0.1},), ({"question": 0.0, "meme": 0.0},),
    ]
    got = spark.createDataFrame(rows, PROBS).select(stance_from_probs("m").alias("s")).collect()
    assert [(r.s.label, r.s.confidence) for r in got] == [
        ("bullish", 0.5), ("neutral", 0.0), ("other", 0.9), ("question", 0.0),
    ]
    assert got[0].s.probs == {"meme": 0.5, "bullish": 0.5, "neutral": 0.25}


def test_conviction_and_weight(spark):
    rows = [("bullish", 0.5, -0.5, "news"), ("meme", 1.0, 1.0, "reddit"), ("bearish", 1.0, 1.0, "other"), ("bearish", 2.0, 1.0, None)]
    df = spark.createDataFrame(rows, "s string, c double, f double, src string")
    got = df.select(conviction(F.col("s"), F.col("c"), F.col("f")), source_weight("src")).collect()
    assert [round(r[0], 9) for r in got] == [0.5, 0.35, 1.0, 1.0]
    assert [r[1] for r in got] == [1.2, 1.0, 1.0, 1.0]


def test_emotion_map(spark):
    df = spark.createDataFrame([([("Joy", 0.5), ("FEAR", 0.25)],), ([],)], "p array<struct<l:string,v:double>>")
    assert [r[0] for r in df.select(emotion_map("p")).collect()] == [{"joy": 0.5, "fear": 0.25}, {}]


def scorers(calls_per_batch: int):
    def make():
        def finance(texts):
            assert len(texts) <= calls_per_batch
            return [{"Positive": len(t) / 10} for t in texts]

        def emotion(texts):
            return [{"Joy": 0.5} if t else {} for t in texts]

        def stance(texts):
            return [{"Bearish": 0.5, "news": 0.25} for t in texts]

        return finance, emotion, stance

    return make


def test_score_and_enrich(spark):
    raw = [
        ("news", "n1", DAY, "ann", "  buy   AA  now", None, {"k": VariantVal.parseJson('"v"')}),
        ("reddit", "r1", DAY, None, " \n ", " ", {}),
        ("reddit", "r2", DAY, "bob", "x" * 9000, None, {}),
    ]
    df = spark.createDataFrame(raw, RAW_POST)
    rows = {r.post_id: r for r in enrich(score_posts(df, scorers(2), batch_size=2), ["AA", "NOW"]).collect()}
    assert list(rows["n1"].asDict()) == ENRICHED_POST.fieldNames()
    assert rows["n1"].tickers == ["AA", "NOW"] and rows["n1"].flags == []
    assert rows["n1"].finbert_score == 1.0  # 10 characters after normalization
    assert rows["n1"].text == "  buy   AA  now" and {k: v.toPython() for k, v in rows["n1"].meta.items()} == {"k": "v"}
    assert rows["n1"].stance_label == "bearish" and rows["n1"].source_weight == 1.2
    assert rows["n1"].language is None and rows["n1"].confidence == 0.5
    assert rows["r1"].flags == ["no_ticker", "empty_text"] and rows["r1"].emotions == {}
    assert rows["r2"].finbert_pos == 900.0 and rows["r2"].finbert_score == 1.0


def test_scorer_must_answer_every_text(spark):
    def make():
        return (lambda t: [], lambda t: [], lambda t: [])

    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match="one result per text"):
        score_posts(df, make).collect()


def test_models_are_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import tempfile

        tempfile.NamedTemporaryFile(dir=folder, delete=False).close()
        none = lambda texts: [{} for _ in texts]
        return none, none, none

    df = spark.range(0, 64, 1, 32).select(F.col("id").cast("string").alias("text"))
    assert score_posts(df, make).select("scores").collect()
    import os

    assert 1 <= len(os.listdir(folder)) <= 8  # 32 tasks on at most 8 workers


def test_equal_labels_up_to_case(spark):
    """The last of them counts; the job doesn't fail."""
    row = spark.range(1).select(
        F.create_map(F.lit("Joy"), F.lit(0.25), F.lit("joy"), F.lit(0.5), F.lit("POSITIVE"), F.lit(0.125)).alias("m")
    )
    (r,) = row.select(
        emotion_map(F.map_entries("m")).alias("e"), sentiment_from_probs("m").alias("s"), stance_from_probs("m").alias("t")
    ).collect()
    assert r.e == {"joy": 0.5, "positive": 0.125} == r.t.probs
    assert (r.s.pos, r.t.label) == (0.125, "joy")


def test_batches_by_length():
    texts = ["a" * n for n in (9, 1, 5, 5, 3, 100, 2)] + [""]
    assert [[len(t) for t in run] for run in length_batches(texts, 3, None)] == [[0, 1, 2], [3, 5, 9], [100]]
    runs = list(length_batches(texts, 3, 10))
    assert [[len(t) for t in run] for run in runs] == [[0, 1, 2], [3, 5], [9], [100]]
    assert list(length_batches([], 3, 10)) == []


def test_scores_keep_the_order_of_rows(spark):
    def make():
        def scorer(texts):
            assert len(texts) <= 4 and (len(texts) == 1 or len(texts) * max(map(len, texts)) <= 60)
            return [{"n": len(t), "first": ord(t[0])} for t in texts]

        return scorer, scorer, scorer

    rows = [(i, chr(97 + i % 26) * (1 + i * 37 % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, text string").repartition(3)
    got = score_posts(df, make, batch_size=4, batch_chars=60).collect()
    assert len(got) == 300
    for r in got:
        expected = {"n": float(len(r.text)), "first": float(ord(r.text[0]))}
        assert r.scores.finance == r.scores.emotion == r.scores.stance == expected and r.text == rows[r.i][1]


def test_validate_raw(spark):
    rows = [
        ("news", "a", DAY, None, "x", None, None), ("news", None, DAY, None, "x", None, {}), (None, "b", DAY, None, "", None, {}),
        ("news", "c", None, None, " ", None, {}), ("news", "d", DAY, None, None, None, {}),
    ]
    good, bad = validate_raw(spark.createDataFrame(rows, RAW_POST), now=F.lit(DAY))
    assert {(r.post_id, r.created_at) for r in good.collect()} == {("a", DAY), ("c", DAY)}
    assert all(r.meta == {} for r in good.collect())
    assert {r.post_id: r.errors for r in bad.collect()} == {
        None: ["post_id missing"], "b": ["source missing", "text empty"], "d": ["text missing"],
    }


def test_validate_enriched(spark):
    rows = [
        {"post_id": "ok", "created_at": DAY, "conviction": None, "flags": None, "source_weight": None},
        {"post_id": "flag", "created_at": DAY, "flags": ["odd"]},
        {"post_id": "range", "created_at": DAY, "finbert_score": 1.5, "conviction": -0.1, "source_weight": -1.0},
        {"post_id": "nan", "created_at": DAY, "finbert_score": float("nan")},
        {"post_id": "when", "created_at": None},
    ]
    good, bad = validate_enriched(enriched(spark, rows), now=F.lit(DAY))
    (ok,) = good.collect()
    assert (ok.post_id, ok.conviction, ok.flags, ok.source_weight, ok.enriched_at) == ("ok", 0.0, [], 1.0, DAY)
    assert {r.post_id: r.errors for r in bad.collect()} == {
        "flag": ["flags unknown"],
        "range": ["finbert_score out of range", "conviction out of range", "source_weight out of range"],
        "nan": ["finbert_score out of range"],
        "when": ["created_at missing"],
    }
