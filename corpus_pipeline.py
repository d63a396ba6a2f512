"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents:

1. quality   documents that the classifier rejects go;
2. near      one document of each group of near duplicates stays (five words, similarity 0.8);
3. secrets   every secret is replaced by a mark;
4. mix       documents are repeated, cut and sorted as the mixture's curriculum says;
5. pack      pieces are packed into sequences of 2048 tokens.

A labelled document is only learned from where it is among the stage's own
documents, and never if it is in the held-out fold.

Defined cases: a null text is judged as an empty one, links with nothing, holds
no secret and is taken 0 times by the mix, as every text without words; a row
without a doc_id is never a near duplicate; different texts of one doc_id are
documents each, unless they link; of equal texts of one doc_id one stays; ties
go to the least doc_id; very long texts go through whole; an empty table gives an
empty result; further columns, whatever their names, are kept up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import free_name, fresh_path
from vecloom.llm.jaccard import representatives
from vecloom.llm.mixing import mixed
from vecloom.llm.packing import best_fit_packing
from vecloom.llm.quality import accepted, train
from vecloom.llm.secrets import redacted, secret_spans
from vecloom.llm.tokens import tokenizer_path

#: SQL for the rows of ``run``: a trained model, tokenizers and packing are beyond SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    return accepted(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least doc_id, of each group of texts that are near duplicates."""
    return representatives(docs, 5, 80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; n_chars follows the text."""
    spans = free_name(docs, "spans")
    clean = redacted(secret_spans(docs, name=spans), name=spans)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut and sort documents as the curriculum takes them; n_chars follows the text."""
    out = mixed(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack documents into sequences of 2048 tokens."""
    return best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"), 2048, 0)


STAGES = [("quality", quality), ("near", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
