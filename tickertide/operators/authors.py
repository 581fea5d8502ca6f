"""Distinct authors as bitmaps, which add up over buckets, batches and wider windows.

An author has a dense number, the busiest ones the lowest. The authors of a (bucket,
ticker) are a few bitmaps, one for each run of 32768 numbers in which it has any.  Their
union is exact, so five-minute rows give the counts of an hour or a day without the posts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tickertide.session import stage_table

STATE = ["bucket_start", "ticker", "part"]


def number_authors(authors: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The dictionary (author_key, number) of the ``author_key`` in ``authors``.

    Numbers are dense from 1, in falling order of the number of rows.  ``known`` is a
    dictionary to extend: its rows stay as they are, and authors it lacks get the numbers
    after its last one.  Null keys get none.  Keep the result with the bitmaps made by it.
    """
    fresh = authors.where("author_key is not null")
    last = 0
    if known is not None:
        fresh = fresh.join(known, "author_key", "left_anti")
        last = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    counted = fresh.groupBy("author_key").agg(F.count("*").alias("n"))
    ranked = counted.orderBy(F.desc("n"), "author_key").withColumn("at", F.monotonically_increasing_id())
    # Written once: a place must not change when a lost task is run again.
    placed = stage_table(
        ranked.select("author_key", F.shiftright("at", 33).alias("task"), F.col("at").bitwiseAND(2**33 - 1).alias("row")),
        "author-numbers",
    )
    sizes = placed.groupBy("task").agg(F.count("*").alias("size"))  # one row for each task of the sort
    before = F.sum("size").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("task", F.coalesce(before, F.lit(0)).alias("start"))
    new = placed.join(F.broadcast(starts), "task").select(
        "author_key", (F.col("start") + F.col("row") + 1 + last).alias("number")
    )
    return new if known is None else known.select("author_key", "number").unionByName(new)


def author_bitmaps(authors: DataFrame, numbers: DataFrame) -> DataFrame:
    """Bitmaps (bucket_start, ticker, part, authors) of rows (bucket_start, ticker, author_key).

    Repeated rows count once.  Every author must have a number; one without is an error.
    """
    numbered = authors.join(numbers, "author_key", "left").withColumn(
        "number",
        F.coalesce("number", F.raise_error(F.concat(F.lit("no number for author "), "author_key")).cast("long")),
    )
    part, bit = F.bitmap_bucket_number("number"), F.bitmap_bit_position("number")
    return numbered.groupBy("bucket_start", "ticker", part.alias("part")).agg(
        F.bitmap_construct_agg(bit).alias("authors")
    )


def merge_bitmaps(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The union of bitmaps made by one dictionary or by extensions of it."""
    for other in others:
        first = first.unionByName(other)
    return first.groupBy(*STATE).agg(F.bitmap_or_agg("authors").alias("authors"))


def widen_bitmaps(bitmaps: DataFrame, width: str) -> DataFrame:
    """Bitmaps of any wider tumbling window."""
    wide = bitmaps.withColumn("bucket_start", F.window("bucket_start", width)["start"])
    return merge_bitmaps(wide)


def count_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """Exact counts (bucket_start, ticker, unique_authors)."""
    return bitmaps.groupBy("bucket_start", "ticker").agg(
        F.sum(F.bitmap_count("authors")).alias("unique_authors")
    )
