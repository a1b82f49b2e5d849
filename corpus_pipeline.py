"""A training-corpus pipeline over documents: each stage takes all that the one before it kept, and its decisions take effect.

Stages: toxic documents go; recurring lines go; one document of each group of near copies stays; documents that hold benchmark items go; what is left is
tokenised and decoded again. All but the last return the columns of documents, whatever further ones there are: names of their own results are kept apart.

A null text counts as empty: it isn't toxic, has no lines, is no near copy, holds no item and has no tokens, so it is kept; so are empty texts, each of them. Of
repeated texts the smallest id stays. An empty table of documents gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.llm import contamination, line_templates, minhash_join, piece_bpe, string_kernel
from sweepframe.llm.common import written
from sweepframe.llm.queries import table, vocabulary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; a null text counts as empty."""
    names = ("__held_out", "__score", "__predicted")
    scored = string_kernel.score_toxicity(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns), names=names)
    return scored.where("__predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without recurring lines; a null text stays null."""
    return line_templates.drop_lines(docs, n_lines="__n_lines", n_dropped="__n_dropped").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; null and empty texts are near to nothing."""
    gone = minhash_join.near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id")
    gone = written(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= 2_000_000 else gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; null and empty texts hold none."""
    return contamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and digests of its ids and of their decoded text."""
    return piece_bpe.encode_digests(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: A kernel machine and a tokenizer are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
