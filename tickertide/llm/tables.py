"""Staged tables and size-checked joins shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickertide.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back; cuts the lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.staged_at = path
    return read


def discard(*tables: DataFrame) -> None:
    """Remove staged tables. All that was made from them must be written by now."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it is stored with at most ``rows`` slim rows.

    Counting a staged table reads footers only. Beyond the bound the frame is returned
    as it is, and Spark joins it by shuffle.
    """
    return F.broadcast(df) if df.count() <= rows else df


def lower_ascii(column: Column | str) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
