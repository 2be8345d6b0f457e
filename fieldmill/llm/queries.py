"""The corpus operators as queries: each takes (spark, sf_dir), reads a whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lexical_search, merkle, mixing, ngram_join, packing, quality_rank, quality_rules, spotsigs, sql, suffix_dedup, token_counts, toxicity, warc
from .common import read, shared_dir


def tokenizer(name: str) -> str:
    """A public tokenizer's file, which every machine has at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"), width=4, percent=85).drop("key")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"), window=100).drop("kept")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), digests=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(quality_rank.fold("doc_id", 5) != 0), label="toxic")
    return toxicity.score(docs, model).withColumn("held_out", quality_rank.fold("doc_id", 5) == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read_back(spark, folder).drop("uri")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality_rank.fit(docs, labels.filter(quality_rank.fold("doc_id", 3) != 1), label="quality")
    return quality_rank.score(docs, model).withColumn("held_out", quality_rank.fold("doc_id", 3) == 1)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), top=10)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(read(spark, sf_dir, "documents"), tampered)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.by_document(mixing.mix(read(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)).drop("source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_ngram_join, op2_token_counts, op3_suffix_dedup, op4_document_fingerprints, op5_bpe,
        op6_toxicity, op7_packing, op8_quality_rules, op9_warc, op10_quality_classifier,
        op11_lexical_search, op12_merkle_manifest, op13_source_mix,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the result; the tests compare the others with plain Python and the tokenizers' libraries."""
    return {
        "op1_ngram_join": sql.ngram_join(4, 85),
        "op4_document_fingerprints": sql.fingerprints(),
        "op8_quality_rules": sql.quality_rules(),
        "op9_warc": sql.WARC,
        "op11_lexical_search": sql.lexical_search(10),
        "op12_merkle_manifest": sql.merkle_manifest(),
        "op13_source_mix": sql.source_mix((5, 2, 1), 3),
    }
