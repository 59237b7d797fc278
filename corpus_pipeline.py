"""A corpus pipeline of five corpus operators.

Each stage takes (spark, docs, sf_dir) and returns what it kept; the runner writes that as Parquet and
reads it again for the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_trie, decontaminate, kneser_ney, quality_rules, simhash
from tidemark.llm.common import materialize


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go.

    A null or empty text has no words, so it goes. Texts are measured whole; repeated rows are judged each by itself; columns may have
    any names; an empty table gives none.
    """
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents far less likely than trusted text of their language go.

    A null or empty text has no symbols and goes; a language without trusted text has no model and keeps its other texts, and a null language
    counts as one. Labels with null ids or marks train nothing. Long texts are scored whole, repeated rows
    each by itself; an empty table gives none.
    """
    return kneser_ney.keep_likely(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id, a null one last.

    Of repeated rows one stays; null and empty texts are copies of each other; ties in doc_id are broken by row. An empty table gives none.
    """
    return simhash.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none; null and empty items match nothing, an item with a null id counts. Texts are searched whole, repeated rows
    each by itself; without a benchmark all stay.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, and the digest of what they decode to.

    A null text counts as empty and has no ids. Texts are encoded whole; repeated rows have a row each; an empty table gives none.
    """
    coded = bpe_trie.encode_docs(docs.select("doc_id", "lang", "source", "text"), bpe_trie.vocabulary("byte_bpe_50k.json"))
    n = F.expr("octet_length(ids) div 4").cast("long")
    return coded.select("doc_id", "lang", "source", n.alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("simhash_near_dedup", near_dedup), ("decontamination", benchmarks), ("bpe_encoding", encoding)]

#: SQL can't express the classifier's or the encoder's stage; tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
