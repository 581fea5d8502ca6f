"""The corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickertide.llm.decontaminate import benchmark_hits
from tickertide.llm.jaccard import jaccard_components
from tickertide.llm.packing import pack_sequences
from tickertide.llm.pii import mask_personal_data
from tickertide.llm.queries import tokenizer_path
from tickertide.llm.tables import small, stage, table
from tickertide.llm.toxicity import keep_clean

BROADCAST_IDS = 500_000  # longs


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of some ids; rows that have no id stay."""
    gone = stage(ids.where("doc_id is not null").distinct(), "dropped-ids")
    return docs.join(small(gone, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that are predicted toxic."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group: five-word shingles, similarity 0.8.

    Rows that repeat a doc_id are one document, and the one of the longest text stays.
    """
    groups = stage(jaccard_components(docs, shingle=5, percent=80), "duplicate-groups")
    kept = _without(docs, groups.where("component_id <> doc_id").select("doc_id"))
    twice = stage(
        groups.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"),
        "repeated-ids",
    )
    if twice.isEmpty():
        return kept
    longest = F.max_by(F.struct(*docs.columns), F.struct(F.coalesce(F.length("text"), F.lit(-1)), "text"))
    one = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(longest.alias("row")).select("row.*")
    return _without(kept, twice).unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    hits = benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, hits.where("contaminated").select("doc_id"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in the place of personal data; every document stays."""
    return mask_personal_data(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token sequences of all documents."""
    return pack_sequences(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: The string kernel and the packing can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
