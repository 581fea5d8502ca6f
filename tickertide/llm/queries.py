"""The operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickertide.llm.decontaminate import benchmark_hits
from tickertide.llm.jaccard import jaccard_components
from tickertide.llm.language_model import every_seventh, score_language
from tickertide.llm.lexical_search import ranked_search
from tickertide.llm.near_vectors import near_vectors
from tickertide.llm.oracle import PHRASES, RANKED_SEARCH
from tickertide.llm.packing import pack_sequences
from tickertide.llm.phrases import collocations
from tickertide.llm.pii import personal_data
from tickertide.llm.secrets import find_secrets
from tickertide.llm.sharding import shard_by_bytes
from tickertide.llm.tables import table
from tickertide.llm.token_files import read_token_files, write_token_files
from tickertide.llm.toxicity import toxicity
from tickertide.llm.url_filter import judge_pages
from tickertide.session import scratch_dir


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(table(spark, sf_dir, "documents"), every_seventh())


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, folder)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_ngram_jaccard_join,
        op3_sharding,
        op4_benchmark_decontamination,
        op5_secret_scans,
        op6_url_filters,
        op7_lm_scoring,
        op8_best_fit_packing,
        op9_embedding_near_dedup,
        op10_toxicity,
        op11_lexical_search,
        op12_token_files,
        op13_phrases,
    )
}

#: DuckDB twins, where SQL can express the rows.
ORACLE: dict[str, str] = {"op11_lexical_search": RANKED_SEARCH, "op13_phrases": PHRASES}
