"""The registered queries of this subpackage: each runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from ._common import table
from .arrow_output import read_token_files, write_token_files
from .decontaminate import find_leaks
from .minhash import near_duplicates
from .packing import pack_documents
from .quality import quality_verdicts
from .secret_scan import scan
from .substring_dedup import remove_repeated_words
from .suffix_dedup import remove_repeated_bytes
from .toxicity import score_documents
from .url_rules import judge_urls


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), max_tokens=2048)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), length=50)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=5, percent=75)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents"), length=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_secret_scan,
        op3_quality_rules,
        op4_benchmark_leaks,
        op5_suffix_dedup,
        op6_minhash_dedup,
        op7_token_files,
        op8_toxicity,
        op9_url_rules,
        op10_substring_dedup,
    )
}

#: The others can't be stated in SQL as a whole (a tokenizer, packing, guess costs, alignments, trees):
#: tests hold them against brute force, a round trip or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": sql.QUALITY,
    "op9_url_rules": sql.URL_VERDICTS,
    "op5_suffix_dedup": sql.REPEATED_BYTES,
    "op6_minhash_dedup": sql.NEAR_DUPLICATES,
    "op10_substring_dedup": sql.REPEATED_WORDS,
}
