"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tickertide.llm.tables import stage


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Cut ``docs`` (doc_id, text), ordered by doc_id, into contiguous shards of equal bytes.

    A row weighs the UTF-8 bytes of its text plus 1; a null text weighs 1 and has the
    checksum 0. Rows are dealt into key ranges, each range is summed, and the running sum
    over the ranges (one row each) gives every range its global start. A row belongs to the
    shard in which its middle byte falls, so a shard is off its target by one row at most.
    Rows without doc_id come first; equal ids are ordered by checksum, size and place in
    the input, which also splits an id that many rows share over several ranges. Other
    columns are ignored. An empty table gives no rows.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    order = ["doc_id", "text_crc32", "size", "place"]
    slim = stage(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "shard-sizes",
    )
    ranged = stage(
        slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-ranges"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("part_bytes").over(everything).alias("all_bytes"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per range of the shuffle: bounded by the number of partitions.
    placed = ranged.join(F.broadcast(ranges), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("bytes_before") + F.sum("size").over(running) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("row"),
        "all_bytes",
    )
    middle = (F.col("start") * 2 + F.col("size")) * shards
    cut = stage(
        placed.select(
            "doc_id",
            "size",
            "text_crc32",
            "row",
            F.call_function("div", middle, F.col("all_bytes") * 2).cast("int").alias("shard"),
        ),
        "shard-cuts",
    )
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first_row"))
    return cut.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
