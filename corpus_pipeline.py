"""A training-data pipeline over the documents table: each stage calls one corpus operator.

Every stage takes the rows that the stage before kept and is written as Parquet before the next one reads it. All
stages but the last return the columns of documents; n_chars follows the text where a stage changes it.

A null text counts as empty and may stay; a null doc_id, lang or source is carried along. Rows with the same doc_id are
documents of their own: of equal or nearly equal texts one row stays. An empty table gives an empty result at every stage; without
any label the first two stages keep all documents. Further columns of the table take no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import ngram_join, packing, quality_rank, suffix_dedup, toxicity
from fieldmill.llm.common import keyed, read, staged
from fieldmill.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier puts below its threshold; it learns from all labels of the documents here."""
    model = quality_rank.fit(docs, read(spark, sf_dir, "labels"), label="quality")
    return quality_rank.score(docs, model, COLUMNS).filter("predicted = 1").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the toxicity model scores at one half or more; it learns from all labels of the documents here."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), label="toxic")
    return toxicity.score(docs, model, COLUMNS).filter("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, likeness 0.8) the document of the smallest id."""
    rows = keyed(docs)
    kept = ngram_join.groups(rows.select("key", "text"), width=5, percent=80).filter("key = component").select("key")
    return rows.join(kept, "key", "left_semi").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 100 bytes or more that occur earlier in the corpus; a document of which nothing is left goes."""
    left = suffix_dedup.dedup(docs, window=100, columns=("doc_id", "lang", "source"))
    cut = left.filter("n_bytes = 0 or n_removed < n_bytes")
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("packing", packed),
]

#: Learned models and hashed passages are no SQL; the tests compare the stages with plain Python on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
