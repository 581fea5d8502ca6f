"""Stored tables: posts, authors and rollup deltas, one folder per stream run and batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickertide.functions.time import at_or_after, utc, utc_date
from tickertide.operators.rollup import sum_rollup
from tickertide.schema import AUTHORS, ENRICHED_POST, ENRICHED_STORED, RAW_POST, ROLLUP

RAW_TABLE, ENRICHED_TABLE = "raw_posts", "enriched_posts"
AUTHOR_TABLE, ROLLUP_TABLE = "ticker_author_5m", "ticker_agg_5m"
KEY_TABLE, RECOMPUTED_TABLE, COMMITS = "post_keys", "ticker_agg_5m_recomputed", "commits"
POST_KEYS = ["source", "post_id"]
# Posts are looked up by a hash of their key; a batch opens the buckets of its own keys only.
KEY_BUCKETS = 256
# After so many batches their keys are put together in one folder.
KEY_BATCHES = 64
_SCHEMAS = {
    RAW_TABLE: RAW_POST,
    ENRICHED_TABLE: T.StructType([f for f in ENRICHED_POST.fields if f.name in ENRICHED_STORED]),
    AUTHOR_TABLE: AUTHORS,
    ROLLUP_TABLE: ROLLUP,
}
_DAY_OF = {
    RAW_TABLE: "created_at",
    ENRICHED_TABLE: "created_at",
    AUTHOR_TABLE: "bucket_start",
    ROLLUP_TABLE: "bucket_start",
}


def stored_runs(spark: SparkSession, root: str) -> set[str]:
    """The runs that have written below ``root``."""
    files, folder = _path(spark, f"{root}/{RAW_TABLE}")
    if not files.exists(folder):
        return set()
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return {n.removeprefix("run=") for n in names if n.startswith("run=")}


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def is_written(spark: SparkSession, folder: str) -> bool:
    """Whether a write of this folder was committed."""
    files, path = _path(spark, f"{folder}/_SUCCESS")
    return files.exists(path)


def commit_batch(spark: SparkSession, root: str, run: str, batch_id: int) -> None:
    """Mark a batch as written in all tables; readers take it from here on."""
    files, path = _path(spark, f"{root}/{COMMITS}/run={run}/{batch_id}")
    files.create(path, True).close()
    for older in files.listStatus(path.getParent()):
        if int(older.getPath().getName()) < batch_id:
            files.delete(older.getPath(), False)


def committed(spark: SparkSession, root: str) -> dict[str, int]:
    """The last marked batch of each run; the batches of a run are written one after the other."""
    files, folder = _path(spark, f"{root}/{COMMITS}")
    if not files.exists(folder):
        return {}
    last = {}
    for run in files.listStatus(folder):
        marks = [int(f.getPath().getName()) for f in files.listStatus(run.getPath())]
        if marks:
            last[run.getPath().getName().removeprefix("run=")] = max(marks)
    return last


def _marked(rows: DataFrame, last: dict[str, int]) -> DataFrame:
    marked = F.lit(False)
    for run, batch_id in sorted(last.items()):  # few: one for each fresh checkpoint
        marked |= (F.col("run") == run) & (F.col("batch_id") <= batch_id)
    return rows.filter(marked)


def key_bucket() -> Column:
    return F.pmod(F.xxhash64(*POST_KEYS), F.lit(KEY_BUCKETS)).cast("int").alias("bucket")


_KEYS = T.StructType(
    [RAW_POST[n] for n in POST_KEYS]
    + [T.StructField(*f) for f in (("run", T.StringType()), ("batch_id", T.LongType()), ("bucket", T.IntegerType()))]
)


def _read_or_empty(spark: SparkSession, schema: T.StructType, folder: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_keys(spark: SparkSession, root: str, posts: DataFrame, before: tuple[str, int]) -> DataFrame:
    """The stored keys in the buckets that ``posts`` touch, whatever the days of either."""
    buckets = [r.bucket for r in posts.select(key_bucket()).distinct().collect()]  # KEY_BUCKETS at most
    keys = _read_or_empty(spark, _KEYS, f"{root}/{KEY_TABLE}")
    return _before(keys.filter(F.col("bucket").isin(buckets)), before).select(*POST_KEYS)


def write_keys(posts: DataFrame, root: str, run: str, batch_id: int) -> None:
    """Write the keys of a batch by bucket. Each ``KEY_BATCHES``-th batch takes in those since the last one."""
    spark = posts.sparkSession
    keys = posts.select(*POST_KEYS, key_bucket())
    folder = f"{root}/{KEY_TABLE}/run={run}/batch_id="
    older = []
    if batch_id % KEY_BATCHES == KEY_BATCHES - 1:
        older = [n for n in range(batch_id - KEY_BATCHES + 1, batch_id) if is_written(spark, f"{folder}{n}")]
    if older:
        kept = _read_or_empty(spark, _KEYS, f"{root}/{KEY_TABLE}").filter(
            (F.col("run") == run) & F.col("batch_id").between(older[0], older[-1])
        )
        keys = keys.unionByName(kept.select(*POST_KEYS, "bucket")).distinct()
    (
        keys.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", *POST_KEYS)
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{folder}{batch_id}")
    )


def drop_merged_keys(spark: SparkSession, root: str, run: str, batch_id: int) -> None:
    """Remove the key folders that the last merging batch took in, once that batch is marked."""
    if batch_id % KEY_BATCHES != KEY_BATCHES - 1:
        return
    for n in range(batch_id - KEY_BATCHES + 1, batch_id):
        files, path = _path(spark, f"{root}/{KEY_TABLE}/run={run}/batch_id={n}")
        if files.exists(path):
            files.delete(path, True)


def write_batch(df: DataFrame, root: str, table: str, run: str, batch_id: int) -> None:
    """Write one batch of a table, partitioned by UTC day.

    The folder is named by the run and the batch id and replaced whole, so writing the same
    batch again changes nothing, and no other run's batches are touched.
    """
    day_of = _DAY_OF[table]
    rows = df.select(*_SCHEMAS[table].fieldNames()).withColumn("day", utc_date(day_of))
    # Few files per day: small days are packed together and a heavy day is split
    # at run time.  Sorted, so that row-group statistics prune inside a day.
    (
        rows.hint("rebalance", "day")
        .sortWithinPartitions("day", day_of)
        .write.mode("overwrite")
        .partitionBy("day")
        .parquet(f"{root}/{table}/run={run}/batch_id={batch_id}")
    )


def read_table(
    spark: SparkSession, root: str, table: str, before: tuple[str, int] | None = None
) -> DataFrame:
    """All marked batches of a table, or those before a (run, batch id); other runs came earlier.

    A batch that is being written, or was left half written, is not there.
    """
    schema = T.StructType(
        _SCHEMAS[table].fields
        + [T.StructField(*f) for f in (("run", T.StringType()), ("batch_id", T.LongType()), ("day", T.DateType()))]
    )
    rows = _marked(_read_or_empty(spark, schema, f"{root}/{table}"), committed(spark, root))
    return rows if before is None else _before(rows, before)


def read_batch(spark: SparkSession, root: str, table: str, run: str, batch_id: int) -> DataFrame:
    """What ``write_batch`` has just written, marked or not."""
    folder = f"{root}/{table}/run={run}/batch_id={batch_id}"
    return _read_or_empty(spark, T.StructType(_SCHEMAS[table].fields), folder)


def _before(rows: DataFrame, before: tuple[str, int]) -> DataFrame:
    run, batch_id = before
    return rows.filter((F.col("run") != run) | (F.col("batch_id") < batch_id))


def read_rollup(spark: SparkSession, root: str, since: datetime | str | None = None) -> DataFrame:
    """The rollup table: the sum of its deltas by (bucket_start, ticker).

    ``since`` limits the scan to the days from that moment on; a further filter
    on ``bucket_start`` is pushed through the sum to the scan as well.
    """
    deltas = read_rollup_deltas(spark, root, since)
    summed = sum_rollup(deltas, ["bucket_start", "ticker"], with_authors=True)
    return summed.select(*ROLLUP.fieldNames())


def read_rollup_deltas(
    spark: SparkSession, root: str, since: datetime | str | None = None
) -> DataFrame:
    """The stored deltas as they are: several rows may share a (bucket_start, ticker)."""
    deltas = read_table(spark, root, ROLLUP_TABLE)
    if since is None:
        return deltas
    return deltas.filter(F.col("day") >= F.lit(utc(since).date())).filter(at_or_after("bucket_start", since))


def read_rollup_jdbc(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """A rollup kept in a relational table; its emotion sums arrive as JSON text."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=ROLLUP_TABLE, **options).load()
    sums = F.from_json(F.col("emotion_sums").cast("string"), "map<string,double>")
    return rows.withColumn("emotion_sums", sums).select(*ROLLUP.fieldNames())


def pack_tables(spark: SparkSession, root: str, new_root: str, run: str, batch_id: int) -> None:
    """Write every table as the single batch ``batch_id`` of a run below a new root.

    Fewer folders to list and fewer deltas to sum.  Use the run and the last batch of a
    stopped stream; the stream then goes on below the new root.
    """
    for table in (RAW_TABLE, ENRICHED_TABLE, AUTHOR_TABLE):
        write_batch(read_table(spark, root, table), new_root, table, run, batch_id)
    write_keys(read_table(spark, root, RAW_TABLE), new_root, run, batch_id)
    write_batch(read_rollup(spark, root), new_root, ROLLUP_TABLE, run, batch_id)
    commit_batch(spark, new_root, run, batch_id)
