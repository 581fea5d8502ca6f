from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from tickertide.operators.authors import (
    author_bitmaps,
    count_bitmaps,
    merge_bitmaps,
    number_authors,
    widen_bitmaps,
)

DAY = datetime(2024, 1, 1)
SCHEMA = "bucket_start timestamp, ticker string, author_key string"


def made(n, authors, seed):
    rng = random.Random(seed)
    return [
        (DAY + timedelta(minutes=5 * rng.randrange(60)), rng.choice(["AA", "B"]), f"r:{rng.randrange(authors)}")
        for _ in range(n)
    ]


def by_hand(rows, minutes):
    seen = defaultdict(set)
    for at, ticker, author in rows:
        start = DAY + (at - DAY) // timedelta(minutes=minutes) * timedelta(minutes=minutes)
        seen[(start, ticker)].add(author)
    return {key: len(found) for key, found in seen.items()}


def counted(bitmaps):
    rows = count_bitmaps(bitmaps).collect()
    return {(r.bucket_start, r.ticker): r.unique_authors for r in rows}


def test_numbers_are_dense_and_stay(spark):
    first, second = (spark.createDataFrame(made(2000, n, n), SCHEMA) for n in (300, 500))
    numbers = number_authors(first)
    old = {r.author_key: r.number for r in numbers.collect()}
    assert sorted(old.values()) == list(range(1, len(old) + 1))
    ranked = first.groupBy("author_key").count().orderBy("count", ascending=False).first()
    assert first.where(first.author_key == min(old, key=old.get)).count() == ranked["count"]
    new = {r.author_key: r.number for r in number_authors(second, numbers).collect()}
    assert {a: new[a] for a in old} == old and sorted(new.values()) == list(range(1, len(new) + 1))
    none = spark.createDataFrame([(DAY, "AA", None)], SCHEMA)
    assert number_authors(none).count() == 0 and number_authors(none, numbers).count() == len(old)


def test_bitmaps_add_up(spark):
    rows = made(5000, 400, 1), made(4000, 900, 2)
    first, second = (spark.createDataFrame(r, SCHEMA) for r in rows)
    numbers = number_authors(first)
    more = number_authors(second, numbers)
    both = merge_bitmaps(author_bitmaps(first, numbers), author_bitmaps(second, more))
    for minutes in (5, 60, 1440):
        wide = both if minutes == 5 else widen_bitmaps(both, f"{minutes} minutes")
        assert counted(wide) == by_hand(rows[0] + rows[1], minutes)
    assert counted(merge_bitmaps(both, both)) == counted(both)


def test_authors_over_many_parts(spark):
    rows = [(DAY, "AA", f"r:{i}") for i in range(70_000)] + [(DAY, "B", f"r:{i}") for i in range(0, 70_000, 7)]
    authors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    bitmaps = author_bitmaps(authors, number_authors(authors))
    assert bitmaps.where("ticker = 'AA'").count() == 3
    assert counted(bitmaps) == {(DAY, "AA"): 70_000, (DAY, "B"): 10_000}


def test_author_without_a_number(spark):
    authors = spark.createDataFrame(made(10, 5, 3), SCHEMA)
    numbers = number_authors(authors.limit(0))
    with pytest.raises(Exception, match="no number for author"):
        author_bitmaps(authors, numbers).collect()
    assert author_bitmaps(authors.limit(0), numbers).count() == 0
