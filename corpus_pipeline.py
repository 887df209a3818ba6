"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontam, minhash, mixing, token_output, toxicity
from granary.llm.common import free_name, fresh_path, table
from granary.llm.queries import tokenizer_path


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.5 or more) go; null and empty texts and null ids are scored like any."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.with_score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity of 0.8 or more) the least doc_id stays.

    Texts without words are in no group, and a null doc_id stays.
    """
    gone = minhash.near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"), k=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: a row for each copy that the mix takes, in training order.

    Null texts and ids and repeated rows are documents as any; see mixing.mixture.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix is written as token files in its training order, the order of the files of docs; a row for each document
    that they hold. Docs that aren't read from files are written in the order of doc_id."""
    return token_output.token_output(docs, tokenizer_path(), end_id=2, order=token_output.file_order(docs))


STAGES = [("toxicity", not_toxic), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("mixing", mixed), ("tokens", tokens)]

#: Trees, MinHash and a tokenizer are beyond SQL; tests/llm compares stages 2 to 5 with brute force or SQL on the smallest
#: tables. Stage 1 is learned: its split is compared with the scores of op5, whose accuracy is tested apart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
