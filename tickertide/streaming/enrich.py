"""Raw stream to enriched stream: arrivals are staged, the rule runs on keys, texts are joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tickertide.functions.text import dedup_key
from tickertide.operators.dedup import TTL_SECONDS
from tickertide.operators.merge import first_by_key
from tickertide.operators.scoring import ScorerFactory, enrich, score_posts
from tickertide.operators.validate import validate_raw
from tickertide.schema import RAW_POST
from tickertide.session import ROCKSDB_PROVIDER
from tickertide.sources.tables import is_written
from tickertide.sources.topics import to_wire, write_enriched_posts
from tickertide.streaming.dedup import dedup_stream_event_time

POSTS, ARRIVALS = "posts", "arrivals"
_KEYED = T.StructType([*RAW_POST.fields, T.StructField("dedup_key", T.StringType())])
_INSTANT = ["dedup_key", "created_at"]
_ARRIVAL = T.StructType([_KEYED[n] for n in (*_INSTANT, "source", "post_id")])
_BATCH = T.StructField("batch", T.LongType())


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, _BATCH])


def stage_arrivals(root: str, quarantine: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: write the valid posts, and what the time-to-live rule needs of them.

    Of the rows of a key at one instant only the least (source, post_id) can be kept, so each
    micro-batch is reduced to that, with partial aggregation before the shuffle: a key that
    fills the stream reaches one task with its distinct instants alone, and without texts. Both folders are named by
    the batch and written once: a replayed batch finds them and changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good, bad = validate_raw(batch)
        if quarantine:
            bad.write.mode("overwrite").json(f"{quarantine}/batch_id={batch_id}")
        posts = f"{root}/{POSTS}/batch={batch_id}"
        if not is_written(spark, posts):
            good.withColumn("dedup_key", dedup_key("url", "text")).write.mode("overwrite").parquet(posts)
        arrivals = f"{root}/{ARRIVALS}/batch={batch_id}"
        if not is_written(spark, arrivals):
            stored = spark.read.schema(_KEYED).parquet(posts)
            least = stored.groupBy(*_INSTANT).agg(F.min(F.struct("source", "post_id")).alias("id"))
            least.select(*_INSTANT, "id.source", "id.post_id").write.mode("overwrite").parquet(arrivals)

    return write


def start_arrivals(
    raw: DataFrame, root: str, checkpoint: str, quarantine: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Run ``stage_arrivals`` over a raw stream. Rows that are not valid go below ``quarantine``."""
    return (
        raw.writeStream.foreachBatch(stage_arrivals(root, quarantine))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def kept_posts(kept: DataFrame, root: str) -> DataFrame:
    """The staged posts of the kept (dedup_key, created_at, source, post_id, batch), one each.

    Only the folders of those batches are read. Rows that share all five are copies; the
    first in a total order of their contents counts.
    """
    spark = kept.sparkSession
    batches = sorted(r.batch for r in kept.select("batch").distinct().collect())  # micro-batches
    posts = spark.read.schema(_with_batch(_KEYED)).parquet(f"{root}/{POSTS}").where(F.col("batch").isin(batches))
    names = [*_ARRIVAL.fieldNames(), "batch"]
    chosen = posts.join(kept.select(*names), names, "left_semi")
    ordered = chosen.withColumn("_order", F.xxhash64(F.to_json(F.struct(*_KEYED.fieldNames()))))
    return first_by_key(ordered, names, ["_order"]).select(*_KEYED.fieldNames())


def start_enrich(
    spark: SparkSession,
    root: str,
    sink: dict | str,
    checkpoint: str,
    make_scorers: ScorerFactory,
    allow: DataFrame | Iterable[str] | None = None,
    ttl_seconds: float = TTL_SECONDS,
    lateness_seconds: float | None = None,
    trigger: dict | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Staged arrivals to enriched posts: the time-to-live rule on keys, texts back, scores, tickers.

    ``sink`` is a folder, where each batch writes a folder of its own, so that a replay
    changes nothing, or Kafka options, where a replay sends its posts again under the same keys.
    No post is dropped for lateness unless ``lateness_seconds`` says so. Sets the RocksDB state provider.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    reader = spark.readStream.schema(_with_batch(_ARRIVAL))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    kept = dedup_stream_event_time(
        reader.parquet(f"{root}/{ARRIVALS}"), ttl_seconds=ttl_seconds, lateness_seconds=lateness_seconds
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the stateful plan runs once
        try:
            enriched = enrich(score_posts(kept_posts(batch, root), make_scorers), allow)
            if isinstance(sink, str):
                to_wire(enriched).select("value").write.mode("overwrite").text(f"{sink}/batch_id={batch_id}")
            else:
                write_enriched_posts(enriched, sink)
        finally:
            batch.unpersist()

    return (
        kept.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )
