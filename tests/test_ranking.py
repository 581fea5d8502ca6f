from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

import pytest

from helpers import rollup, same_rows
from tickertide.plans.ranking import movers_api, movers_web, trending_api, trending_web

NOON = datetime(2024, 1, 1, 12)


def bucket(minutes_ago: float, ticker: str, n: int = 1, **more) -> dict:
    return {"bucket_start": NOON - timedelta(minutes=minutes_ago), "ticker": ticker, "mention_count": n, **more}


ROWS = [
    bucket(60, "EDGE", 3),  # exactly at the window start
    bucket(61, "OUT", 9),  # partly covered: left out whole
    bucket(-30, "FUT", 4),  # after as_of
    bucket(5, "BEAR", 2, bearish_count=2, neutral_count=0, sentiment_sum=-1.0),
    bucket(5, "BOTH", 5, news_count=2, reddit_count=3, bullish_count=3, bearish_count=1, neutral_count=1, sentiment_sum=2.5, conviction_sum=4.0, emotion_sums={"joy": 1.0, "sadness": 0.5, "anger": 9.0}),
    bucket(90, "BOTH", 6), bucket(95, "BOTH", 2),
    bucket(400, "BOTH", 20),
    bucket(10, "NEWS", 4, news_count=4, reddit_count=0),
    bucket(10, "ZERO", 0),
]


@pytest.fixture(scope="module")
def rows(spark):
    return rollup(spark, ROWS)


def test_trending(rows):
    got = trending_api(rows, NOON, 60).collect()
    assert [(r.ticker, r.mentions) for r in got] == [
        ("BOTH", 5), ("FUT", 4), ("NEWS", 4), ("EDGE", 3), ("BEAR", 2), ("ZERO", 0),
    ]
    assert {r.ticker: r.sentiment_mean for r in got}["BEAR"] == -0.5
    assert got[-1].sentiment_mean == 0.0  # no counted sentiment
    web = trending_web(rows, NOON, 60, limit=2)
    assert [r.ticker for r in web.collect()] == ["BOTH", "FUT"]
    assert dict(web.dtypes)["mentions"] == "int"


def test_as_of_forms_agree(rows):
    aware = NOON.replace(tzinfo=timezone.utc).astimezone(timezone(timedelta(hours=5)))
    for as_of in (NOON.isoformat(), aware):
        assert same_rows(trending_api(rows, as_of), trending_api(rows, NOON))


def test_movers_api_measures(rows):
    got = {r.ticker: r for r in movers_api(rows, NOON).collect()}
    assert "ZERO" not in got and "OUT" not in got
    both = got["BOTH"]
    rate = (6 + 2 + 20) / 3  # per non-empty bucket
    spike = 5 / (rate * 12 + 1)
    tilt = (1.0 - 0.5) / 5
    score = 0.45 * math.log(6) + 0.35 * math.log(6) * spike + 0.1 * 0.5 + 0.1 * tilt + 0.1 * 0.8 + 0.05
    assert (both.base_rate_5m, both.spike_ratio, both.bullish_ratio) == pytest.approx((rate, spike, 0.75))
    assert (both.emotion_tilt, both.conviction_mean, both.score) == pytest.approx((tilt, 0.8, score))
    assert both.cross_source and not got["NEWS"].cross_source
    assert got["BEAR"].bullish_ratio == 0.0  # a real zero stays zero
    assert got["EDGE"].bullish_ratio == 0.5  # no directional post
    assert got["NEWS"].base_rate_5m == 0.0 and got["NEWS"].spike_ratio == 4.0
    scores = [r.score for r in movers_api(rows, NOON).collect()]
    assert scores == sorted(scores, reverse=True)


def test_movers_api_cross_source_filters_after_the_limit(rows):
    top = [r.ticker for r in movers_api(rows, NOON, limit=2).collect()]
    assert "BOTH" not in top
    assert movers_api(rows, NOON, limit=2, require_cross_source=True).isEmpty()
    assert [r.ticker for r in movers_api(rows, NOON, limit=25, require_cross_source=True).collect()] == ["BOTH"]


def test_movers_web_cross_source_filters_before_the_limit(rows):
    assert [r.ticker for r in movers_web(rows, NOON, limit=1, require_cross_source=True).collect()] == ["BOTH"]


def test_movers_web_measures(rows):
    got = {r.ticker: r for r in movers_web(rows, NOON).collect()}
    both = got["BOTH"]
    assert both.baseline_per_hour == pytest.approx((6 + 2 + 20) / 6)
    assert both.spike_ratio == pytest.approx(5 / ((6 + 2 + 20) / 6 + 1))
    assert both.conviction_mean == pytest.approx(0.8) and both.bullish_ratio == 0.75
    assert got["EDGE"].bullish_ratio == 0.0  # no directional post: 0 here
    assert "ZERO" in got  # no filter on mentions here


def test_baseline_periods_differ(rows):
    # The api baseline ends before it starts once the window is as long as it.
    api = {r.ticker: r for r in movers_api(rows, NOON, window_minutes=360, baseline_hours=6).collect()}
    assert api["BOTH"].base_rate_5m == 0.0 and api["BOTH"].mentions == 13
    # The web baseline always lies before the window, at full length.
    web = {r.ticker: r for r in movers_web(rows, NOON, window_minutes=360, baseline_hours=6).collect()}
    assert web["BOTH"].baseline_per_hour == pytest.approx(20 / 6)


@pytest.mark.parametrize("window,hours", [(60, 24), (5, 1), (360, 6), (240, 3)])
def test_one_scan_equals_join(rows, window, hours):
    for movers in (movers_api, movers_web):
        a = movers(rows, NOON, window, hours, 200)
        b = movers(rows, NOON, window, hours, 200, single_scan=False)
        assert same_rows(a, b)


def test_small_windows_count_as_one_bucket(rows):
    (row,) = [r for r in movers_api(rows, NOON, window_minutes=7).collect() if r.ticker == "BOTH"]
    rate = 28 / 3
    assert row.spike_ratio == pytest.approx(5 / (rate * 1 + 1))
