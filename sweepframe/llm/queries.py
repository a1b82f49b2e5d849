"""The queries of the training-data operators: thin calls over whole tables, each (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.llm import arc_warc, compression_quality, contamination, conversation_repair, license_digest, line_templates, minhash_join, nn_descent, packing, piece_bpe, repeated_strings, string_kernel, token_alignment

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def vocabulary(path: str | None = None) -> dict:
    """The vocabulary of a model file; by default the 32,000-piece one of the installed tokenizer files."""
    import public_tokenizers

    return piece_bpe.load_vocabulary(path or public_tokenizers.path("piece_bpe_32k.model"))


def tokenizer_file(name: str) -> str:
    """The path of one of the installed tokenizer files, which driver and workers share."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_piece_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary())


@query("op7_minhash_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_contamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_line_templates", line_templates.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_license_digest", license_digest.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.license_scan(table(spark, sf_dir, "documents"), license_digest.known_licenses(spark))


@query("op2_compression_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_string_kernel")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_arc_warc", arc_warc.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = arc_warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return records.select(F.col("number").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


@query("op6_repeated_strings")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings.repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


@query("op1_nn_descent", nn_descent.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.linked(table(spark, sf_dir, "embeddings"))


@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_alignment.align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), digest=True).withColumnRenamed("groups", "groups_sha256")


@query("op12_conversation_repair", conversation_repair.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))
