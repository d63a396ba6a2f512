"""The queries of this package, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .oracles import license_sql, rules_sql, secrets_sql
from .tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The others are beyond SQL (tokenizers, models, hashes of this library, approximate search) or, as the Jaccard
#: join, too slow there on whole tables; tests hold them against brute force.
SQL: dict[str, str] = {"op3_license_scans": license_sql(), "op8_quality_rules": rules_sql(), "op9_secret_scans": secrets_sql()}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048, 0)


@query
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import report, secret_spans

    return report(secret_spans(table(spark, sf_dir, "documents")))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import report

    return report(table(spark, sf_dir, "documents"))


@query
def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


@query
def op10_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import sequence_output

    return sequence_output(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2, 2048)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencounts import document_counts

    return document_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 50256)


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"), 4, 85)


@query
def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored, train

    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op1_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS vector")
    return nearest(rows, rows.where("id % 20 = 0"), 20)
