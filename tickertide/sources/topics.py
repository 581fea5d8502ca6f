"""Raw and enriched post topics: Kafka, or JSON lines in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickertide.functions.time import bad_times, iso_z, parse_iso_utc
from tickertide.schema import ENRICHED_POST, ENRICHED_TOPIC, RAW_POST, RAW_TOPIC


def _as_text_times(schema: T.StructType) -> T.StructType:
    """The wire form of a schema: instants travel as ISO text."""
    return T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.dataType == T.TimestampType() else f.dataType)
            for f in schema.fields
        ]
    )


def to_wire(df: DataFrame) -> DataFrame:
    """(key, value): the post id and the JSON text of the row, nulls included."""
    fields = [
        iso_z(f.name).alias(f.name) if f.dataType == T.TimestampType() else F.col(f.name)
        for f in df.schema.fields
    ]
    value = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(F.col("post_id").alias("key"), value.alias("value"))


def from_wire(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Decode JSON values; an undecodable message becomes a row of nulls.

    ``bad_times`` names the times whose text is there but can't be parsed, so that a
    validator tells them from times that are absent.
    """
    row = messages.select(F.from_json(F.col("value").cast("string"), _as_text_times(schema)).alias("r"))
    times = {f.name for f in schema.fields if f.dataType == T.TimestampType()}
    parsed = row.select("r", *[parse_iso_utc(F.col("r")[t]).alias(f"_{t}") for t in sorted(times)])
    return parsed.select(
        *[(F.col(f"_{f.name}") if f.name in times else F.col("r")[f.name]).alias(f.name) for f in schema.fields],
        bad_times({t: (F.col("r")[t], F.col(f"_{t}")) for t in sorted(times)}),
    )


def _read(spark: SparkSession, src: dict | str, schema, topic: str, streaming: bool, max_files=None) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    if isinstance(src, str):
        if streaming and max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return from_wire(reader.text(src), schema)
    options = {"subscribe": topic, "startingOffsets": "earliest", **src}
    return from_wire(reader.format("kafka").options(**options).load(), schema)


def read_raw_posts(
    spark: SparkSession, src: dict | str, streaming: bool = False, max_files: int | None = None
) -> DataFrame:
    """The columns of ``RAW_POST``, and ``bad_times`` for the validators (see ``from_wire``).

    ``src``: a folder of JSON lines, or Kafka options such as
    ``kafka.bootstrap.servers`` and ``maxOffsetsPerTrigger``.

    ``max_files`` limits the files of a micro-batch; no answer depends on it.
    """
    return _read(spark, src, RAW_POST, RAW_TOPIC, streaming, max_files)


def read_enriched_posts(
    spark: SparkSession, src: dict | str, streaming: bool = False, max_files: int | None = None
) -> DataFrame:
    """The columns of ``ENRICHED_POST``, and ``bad_times``, as ``read_raw_posts``."""
    return _read(spark, src, ENRICHED_POST, ENRICHED_TOPIC, streaming, max_files)


def _write(df: DataFrame, sink: dict | str, topic: str, checkpoint: str | None, trigger: dict | None):
    messages = to_wire(df)
    options = {}
    if isinstance(sink, dict):
        options = {"topic": topic, "kafka.acks": "all", **sink}
    if not df.isStreaming:
        if isinstance(sink, str):
            return messages.select("value").write.mode("append").text(sink)
        return messages.write.format("kafka").options(**options).save()
    if isinstance(sink, str):
        writer = messages.select("value").writeStream.format("text").option("path", sink)
    else:
        writer = messages.writeStream.format("kafka").options(**options)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def write_raw_posts(df, sink, checkpoint=None, trigger=None):
    """Publish raw posts keyed by post id; offsets live in the checkpoint of a stream."""
    return _write(df, sink, RAW_TOPIC, checkpoint, trigger)


def write_enriched_posts(df, sink, checkpoint=None, trigger=None):
    return _write(df, sink, ENRICHED_TOPIC, checkpoint, trigger)
