"""Quality rules: base counts, and divergence of a text's histograms from its language's reference.

A text's character classes and its common words are compared with those of all texts in its language by
Jensen-Shannon distance. Only DataFrame functions are used. The references are sums over the whole corpus, so they
cost one shuffle of a few rows per task. A language is a value of the column lang. The references are written, so Spark
knows their size and sends them to all tasks only while they are small.

Nulls: a null text has no words and fails the base rules; a null language shares one reference of its own. A text
below the minimum lengths is left to the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged, words_of

#: Character classes, each with the Java expression for what is NOT in it; "rest" (letters mostly) is what remains.
CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "mark": "[^.,;:!?'\"()\\-]+", "symbol": "[^#*$%&|<>]+"}

#: Common words of each language, the bins of its word histogram.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "auf", "ist", "im", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con"],
}


def repeated_words(words: Column, window: int = 8) -> Column:
    """How many words stand in a window of so many words that occurs twice or more in the text, the first included."""

    def covered(g: Column) -> Column:
        by_hash = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            by_hash,
            lambda s: F.sort_array(
                F.array_compact(
                    F.transform(
                        s,
                        lambda e, k: F.when(
                            (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), e["i"]
                        ),
                    )
                )
            ),
        )
        return let(
            twice,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1), x + window) - x)),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    def joined(step: int):
        return lambda h: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    windows, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < window:  # of twice the width each time; the last step may overlap
        step = min(width, window - width)
        windows = let(windows, joined(step))
        width += step
    windows = let(windows, lambda h: F.slice(h, 1, F.greatest(F.lit(0), F.size(h) - window + 1)))
    return F.when(
        F.size(words) > window,
        let(windows, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long"))),
    ).otherwise(F.lit(0).cast("long"))


def base_counts(docs: DataFrame, *, max_repeat_percent: int = 30, min_words: int = 20, common: dict[str, list[str]] = COMMON) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, and the two histograms: classes and (null for languages without a list) commons."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    lists = F.lit(None).cast("array<string>")
    for lang, words in common.items():
        lists = F.when(F.col("lang") == lang, F.array(*(F.lit(w) for w in words))).otherwise(lists)
    short = F.filter("words", lambda w: F.char_length(w) <= max(len(w) for words in common.values() for w in words))
    commons = let(
        short,
        lambda s: let(
            F.transform(lists, lambda c: F.size(F.filter(s, lambda w: w == c)).cast("long")),
            lambda n: F.concat(n, F.array(F.size("words") - F.aggregate(n, F.lit(0).cast("long"), lambda a, v: a + v))),
        ),
    )
    long_ = lambda c: c.cast("long")
    counted = base.select(
        "doc_id",
        "lang",
        long_(F.size("words")).alias("n_words"),
        long_(F.char_length(F.array_join("words", ""))).alias("word_chars"),
        long_(F.char_length("text")).alias("n_chars"),
        let(lines, lambda x: long_(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        *(long_(F.char_length(F.regexp_replace("text", p, ""))).alias(f"c_{k}") for k, p in CLASSES.items()),
        commons.alias("commons"),
    )
    known = [F.col("n_chars") - F.col("word_chars"), *(F.col(f"c_{k}") for k in CLASSES)]
    return counted.select(
        "doc_id", "lang", "n_words", "word_chars", "n_chars", "n_dup_lines", "n_repeat_words", "commons",
        F.col("c_symbol").alias("n_symbols"),
        F.array(*known, F.col("n_chars") - sum(known[1:], known[0])).alias("classes"),
        ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))).alias("base_failed"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of counts, arrays of equal length and positive sums."""

    def shares(x: Column) -> Column:
        return let(F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v), lambda s: F.transform(x, lambda v: v / s))

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    both = F.zip_with(shares(p), shares(q), lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, v: a + v) / 2))


def references(counts: DataFrame, common: dict[str, list[str]] = COMMON) -> DataFrame:
    """One row for each language: class_ref and word_ref, the histograms of all its texts together."""
    size = max(map(len, common.values())) + 1
    sums = counts.groupBy("lang").agg(
        *(F.sum(F.col("classes")[i]).alias(f"k{i}") for i in range(len(CLASSES) + 2)),
        *(F.sum(F.get("commons", F.lit(i))).alias(f"w{i}") for i in range(size)),
    )
    return sums.select(
        "lang",
        F.array(*(f"k{i}" for i in range(len(CLASSES) + 2))).alias("class_ref"),
        F.array_compact(F.array(*(f"w{i}" for i in range(size)))).alias("word_ref"),
    )


def judge(
    docs: DataFrame,
    *,
    max_class_distance: float = 0.18,
    max_word_distance: float = 0.25,
    min_chars: int = 100,
    min_words_compared: int = 60,
    common: dict[str, list[str]] = COMMON,
) -> DataFrame:
    """The base counts with class_distance, word_distance (null below the minimum lengths) and kept.

    A text stays if the base rules pass and neither distance that could be measured exceeds its limit. Rows are
    judged one by one, so repeated rows and repeated ids stay. Texts are read once: the counts are written, and the
    references and the verdict come from them.
    """
    counts = staged(base_counts(docs, common=common), "rules")
    both = counts.join(staged(references(counts, common), "references"), "lang", "left")  # sent to all tasks if its written size allows it
    measured = both.select(
        "*",
        F.when(F.col("n_chars") >= min_chars, distance(F.col("classes"), F.col("class_ref"))).alias("class_distance"),
        F.when(F.col("n_words") >= min_words_compared, distance(F.col("commons"), F.col("word_ref"))).alias("word_distance"),
    )
    fits = (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & fits).alias("kept"), "class_distance", "word_distance",
    )
