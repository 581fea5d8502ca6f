"""Stored tables: keys by bucket, marked batches, recomputed hours."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import comparable, enriched, same_rows
from tickertide.operators.merge import insert_if_absent
from tickertide.operators.rollup import rollup_5m
from tickertide.plans import backfill
from tickertide.plans.backfill import (
    read_recomputed,
    rebuild_from_tables,
    rebuild_rollup,
    recompute_touched,
    touched_hours,
)
from tickertide.sources import tables
from tickertide.sources.tables import AUTHOR_TABLE, POST_KEYS, RAW_TABLE, committed, read_rollup, read_table, stored_keys
from tickertide.streaming import rollup as streaming
from tickertide.streaming.rollup import persist_and_roll

DAY = datetime(2024, 1, 1)


def posts(spark, names, at=DAY, **more):
    return enriched(spark, [{"post_id": n, "created_at": at + timedelta(minutes=i), **more} for i, n in enumerate(names)])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_opens_the_buckets_of_its_keys(spark, tmp_path):
    root = str(tmp_path / "out")
    run = persist_and_roll(root, run="r")
    run(posts(spark, [f"p{i}" for i in range(300)]), 0)
    found = stored_keys(spark, root, posts(spark, ["p7"], DAY + timedelta(days=9)), ("r", 1))
    assert [r.post_id for r in found.where("post_id = 'p7'").collect()] == ["p7"]
    assert found.count() < 20  # one bucket of many
    assert "PartitionFilters: [isnotnull(bucket" in plan(found) and "day" not in plan(found)
    files = {f.split("bucket=")[1].split("/")[0] for f in found.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(files) == 1


def test_merged_keys_stay_known(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "KEY_BATCHES", 3)
    root = str(tmp_path / "out")
    run = persist_and_roll(root, run="r")
    for batch in range(7):
        run(posts(spark, [f"p{batch}", f"p{batch - 1}", "p0"], DAY + timedelta(days=batch)), batch)
        run(posts(spark, [f"p{batch}", f"p{batch - 1}", "p0"], DAY + timedelta(days=batch)), batch)  # replayed
    assert sorted(r.post_id for r in read_table(spark, root, RAW_TABLE).collect()) == sorted(["p-1"] + [f"p{i}" for i in range(7)])
    folders = {p.name for p in (tmp_path / "out" / tables.KEY_TABLE / "run=r").iterdir() if p.is_dir()}
    assert folders == {"batch_id=2", "batch_id=5", "batch_id=6"}


@pytest.mark.parametrize("after", ["write_keys", "write_batch", "commit_batch"])
def test_half_a_batch_is_not_read(spark, tmp_path, monkeypatch, after):
    """A job that dies between two writes leaves the old state; the replay completes it."""
    root = str(tmp_path / "out")
    run = persist_and_roll(root, run="r")
    run(posts(spark, ["a", "b"]), 0)
    before = sorted(map(str, comparable(read_rollup(spark, root)).collect()))
    calls = []

    def die(*args, **kwargs):
        calls.append(args)
        if after != "write_batch" or len(calls) == 3:  # the third table
            raise RuntimeError("killed")
        return tables.write_batch(*args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(streaming, after, die)
        with pytest.raises(RuntimeError, match="killed"):
            run(posts(spark, ["b", "c"]), 1)
    assert read_table(spark, root, RAW_TABLE).count() == 2 and committed(spark, root) == {"r": 0}
    assert sorted(map(str, comparable(read_rollup(spark, root)).collect())) == before
    run(posts(spark, ["b", "c"]), 1)
    assert sorted(r.post_id for r in read_table(spark, root, RAW_TABLE).collect()) == ["a", "b", "c"]
    assert committed(spark, root) == {"r": 1}


def test_only_the_touched_hours_are_recomputed(spark, tmp_path):
    root = str(tmp_path / "out")
    run = persist_and_roll(root, run="r")
    whole = posts(spark, [f"p{i}" for i in range(400)])  # almost seven hours
    run(whole, 0)
    recompute_touched(spark, root, touched_hours(whole))
    assert same_rows(comparable(read_recomputed(spark, root)), comparable(rollup_5m(whole)))
    folder = tmp_path / "out" / tables.RECOMPUTED_TABLE
    before = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    late = posts(spark, ["late1", "late2"], DAY + timedelta(hours=3, minutes=50), author="zoe")
    again = posts(spark, ["p5"], DAY + timedelta(hours=5))  # stored already: changes nothing
    run(late.unionByName(again), 1)
    hours = touched_hours(late)
    assert [h.hour for h in hours] == [3]
    recompute_touched(spark, root, hours)
    assert same_rows(comparable(read_recomputed(spark, root)), comparable(rollup_5m(whole.unionByName(late))))
    assert same_rows(comparable(read_recomputed(spark, root)), comparable(read_rollup(spark, root)))
    after = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    changed = {p.parent.name for p in before.keys() ^ after.keys()}
    assert changed == {"hour=3"} and all(after[p] == t for p, t in before.items() if p in after)
    recompute_touched(spark, root, [])


def test_recompute_reads_the_touched_parts(spark, tmp_path):
    from tickertide.plans.backfill import _in_hours

    root = str(tmp_path / "out")
    persist_and_roll(root, run="r")(posts(spark, ["a"]), 0)
    hours = [DAY.replace(hour=h) for h in (1, 2, 5)]
    rows = read_table(spark, root, RAW_TABLE).where(F.col("day").isin([DAY.date()]) & _in_hours("created_at", hours))
    text = plan(rows)
    assert "day#" in text.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(created_at" in text


def test_authors_of_stored_posts_are_not_broadcast(spark, tmp_path):
    """Estimates say that they are few; a row for each post would go through the driver."""
    root = str(tmp_path / "out")
    whole = posts(spark, [f"p{i}" for i in range(30)])
    persist_and_roll(root, run="r")(whole, 0)
    rebuilt = rebuild_from_tables(spark, root)
    assert "Broadcast" not in plan(rebuilt) and plan(rebuilt).count("SortMergeJoin") == 1
    assert same_rows(comparable(rebuilt), comparable(rollup_5m(whole)))


def test_authors_of_recomputed_hours_are_not_broadcast(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    whole = posts(spark, [f"p{i}" for i in range(90)])
    persist_and_roll(root, run="r")(whole, 0)
    found = []
    monkeypatch.setattr(backfill, "rebuild_rollup", lambda rows: found.append(rebuild_rollup(rows)) or found[-1])
    recompute_touched(spark, root, touched_hours(whole))
    assert "Broadcast" not in plan(found[0]) and plan(found[0]).count("SortMergeJoin") == 1
    assert same_rows(comparable(read_recomputed(spark, root)), comparable(rollup_5m(whole)))


def test_keys_are_broadcast_for_few_rows_only(spark):
    schema = "source string, post_id string, seq int"
    stored = spark.createDataFrame([("news", "a", 0), (None, "b", 0), ("news", None, 0)], schema)
    rows = [("news", "a", 1), ("news", "b", 2), ("news", "b", 1), (None, "b", 1), ("news", None, 1)]
    batch = spark.createDataFrame(rows, schema)
    many, few = (insert_if_absent(stored, batch, POST_KEYS, ["seq"], few=f) for f in (False, True))
    assert "Broadcast" not in plan(many) and plan(many).count("SortMergeJoin") == 2
    assert plan(few).count("BroadcastHashJoin") == 1
    assert same_rows(many, few)
    assert sorted(map(str, many.collect())) == sorted(map(str, spark.createDataFrame(rows[2:], schema).collect()))


@pytest.mark.parametrize("most", [0, 100])
def test_a_batch_of_many_posts_is_not_broadcast(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(streaming, "FEW_ROWS", most, raising=False)
    root = str(tmp_path / "out")
    run = persist_and_roll(root, run="r")
    run(posts(spark, ["a", "b"]), 0)
    plans = {}

    def write(df, root, table, *where):
        plans[table] = plan(df)
        return tables.write_batch(df, root, table, *where)

    monkeypatch.setattr(streaming, "write_batch", write)
    run(posts(spark, ["b", "c"], author="zoe"), 1)
    assert ("BroadcastHashJoin" in plans[RAW_TABLE]) == (most > 0)
    assert plans[AUTHOR_TABLE].split("InMemoryTableScan")[0].count("SortMergeJoin") == 1
    assert sorted(r.post_id for r in read_table(spark, root, RAW_TABLE).collect()) == ["a", "b", "c"]
    assert read_table(spark, root, AUTHOR_TABLE).count() == 2
