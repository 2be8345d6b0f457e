"""Document fingerprints by spot signatures, with DataFrame functions only.

A spot signature is a common-word anchor and the chain of content words that follow it; a text's fingerprint is the
set of its signatures. Sets are partitioned by size, so that two sets whose sizes alone rule out a likeness are never
compared, and the rest are compared by Jaccard likeness.

Nulls: a null text counts as empty. A text without any word has its own text as its only signature. Texts that are
equal have equal fingerprints, so ties and repeated rows do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, let

#: Anchors: common words of several languages.
ANCHORS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "aux", "dans", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "al", "con", "de", "del", "el", "las", "los", "no", "para", "por", "se", "su", "una", "y",
]


def signatures(text: Column, *, chain: int = 2) -> Column:
    """The sorted set of a text's spot signatures, each the first eight digits of its MD5 sum.

    The start of the text is an anchor as well. At the end of the text a chain may be shorter than asked.
    """
    plain = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N} \\n]+", "")
    words = F.filter(F.split(F.replace(plain, F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")
    is_anchor = lambda w: w.isin(ANCHORS)

    def spots(w: Column) -> Column:
        at = F.array_compact(F.transform(w, lambda x, i: F.when(is_anchor(x), i)))  # the k-th of them has k anchors before it
        content = F.filter(w, lambda x: ~is_anchor(x))
        return let(
            content,
            lambda c: F.concat(
                F.when(F.size(c) > 0, F.array(F.array_join(F.slice(c, 1, chain), " "))).otherwise(F.array().cast("array<string>")),
                F.transform(
                    F.filter(F.transform(at, lambda i, k: F.struct(i.alias("i"), (i - k).alias("c"))), lambda s: s["c"] < F.size(c)),
                    lambda s: F.concat_ws(" ", F.lit("@"), F.get(w, s["i"]), *(F.get(c, s["c"] + j) for j in range(chain))),
                ),
            ),
        )

    found = let(words, spots)
    return let(
        found,
        lambda s: F.sort_array(
            F.array_distinct(F.transform(F.when(F.size(s) > 0, s).otherwise(F.array(F.concat(F.lit("="), text))), lambda x: F.substring(F.md5(x), 1, 8)))
        ),
    )


def size_partition(size: Column, floor: float) -> Column:
    """Sets whose partitions differ by two or more have a likeness below floor."""
    return F.floor(F.log(size) / F.lit(-math.log(floor)))


def likeness(a: Column, b: Column, *, floor: float = 0.02) -> Column:
    """The Jaccard likeness of two signature sets, 0 where the sizes alone put it below floor."""
    na, nb = F.size(a), F.size(b)
    near = F.abs(size_partition(na, floor) - size_partition(nb, floor)) <= 1
    possible = F.least(na, nb) >= floor * F.greatest(na, nb)
    jaccard = let(F.size(F.array_intersect(a, b)), lambda n: n / (na + nb - n))
    return F.when(near & possible, jaccard).otherwise(F.lit(0.0))


def with_next(docs: DataFrame, *, rows_per_block: int = 2000) -> DataFrame:
    """block, key, doc_id, text, guest and next_text, the text of the next document by id; after the last comes the first.

    Documents are cut into blocks of about equal counts, whatever their ids are: a block's first key comes from the ids
    alone, dealt by ranges, and each document finds its block by binary search in these keys, of which there is one for
    rows_per_block documents. A block also gets the first document of the block after it, so no task sees more than its
    block: the guest, whose own next_text is null. Rows of one id follow each other by text; a null id comes before all
    others (see keyed()).
    """
    spark = docs.sparkSession
    base = keyed(docs).select("key", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, base.count() // rows_per_block)
    ranged = base.select("key").repartitionByRange(n, "key").withColumn("part", F.spark_partition_id())
    edges = sorted(r.first for r in ranged.groupBy("part").agg(F.min("key").alias("first")).collect())  # one for each block
    steps = [1 << k for k in reversed(range(max(1, len(edges)).bit_length()))]
    first = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<bigint>")
    block = F.reduce(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(first, at + step) <= F.col("key"), at + step).otherwise(at))
    placed = base.select(block.alias("block"), "key", "doc_id", "text", F.lit(False).alias("guest"))
    hosts = spark.createDataFrame([(e, (k - 1) % len(edges)) for k, e in enumerate(edges)], "key long, block int")
    guests = base.join(F.broadcast(hosts) if len(edges) <= 500_000 else hosts, "key").select("block", "key", "doc_id", "text", F.lit(True).alias("guest"))
    return placed.unionByName(guests).withColumn("next_text", F.lead("text").over(following()))


def following() -> Window:
    """The order of documents within their block; the guest comes last."""
    return Window.partitionBy("block").orderBy("guest", "key")


def fingerprints(docs: DataFrame, *, chain: int = 2, floor: float = 0.02, rows_per_block: int = 2000) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likenesses.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.
    """
    pairs = with_next(docs, rows_per_block=rows_per_block)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    sets = pairs.select(
        "block", "guest", "key", "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
        signatures(F.col("text"), chain=chain).alias("own"), F.when(~F.col("guest"), signatures(edited, chain=chain)).alias("changed"),
    )
    both = sets.withColumn("next", F.lead("own").over(following())).filter(~F.col("guest"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256",
        F.array_join("own", ",").alias("fingerprint"), F.array_join("changed", ",").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), floor=floor).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), floor=floor).alias("near_next"),
        F.size("own").cast("long").alias("n_signatures"),
    )
