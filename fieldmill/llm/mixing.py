"""Mixing sources to target weights along a curriculum: how much of each source, in which order of training.

1. Targets. Sources share the words of the whole corpus by weight; none gives more than most times its own words, and
   what is left over is shared again among the others by weight, until none is above.
2. Schedule. At each time of training (0 to 1) a source has a share of the mix: its part of the targets, bent by a curve
   that belongs to its weight. Curves are given at evenly spaced times and joined by straight lines; their own mean and
   the mean over all sources are taken out, so that shares add up to 1 at all times and each integrates to the source's target.
3. Positions. A source's documents follow each other in a random but fixed order (MD5 of doc_id), as often as the
   target asks; a document begins where its source's words before it, all rounds counted, are used up. The cumulative
   demand is the integral of the schedule, and its inverse at that point is the document's position in training.
4. Order. Occurrences are sorted by ranges of their positions and numbered in words.

Nothing is drawn at random, so reruns agree. Sums within a source run over ranges (see running()), so a source of any size is
spread over tasks. The last occurrence of a source is cut where its target is reached, so what is taken is the target
to the word.

Nulls: a null text has no words; a null source is a source of its own, the last one; a null doc_id comes first. Rows
with the same doc_id are documents of their own. A document without words, or one that the mix has no room for, stays
with no word taken and no position. Columns other than doc_id, source and text take no part.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, staged, words_of

WEIGHTS = (5, 2, 1)
#: How the shares of sources bend, by the place of their weight: the main sources fade, the smallest come late.
CURVES = ((0.4, 0.0, 0.0, -0.4), (-0.3, 0.3, 0.3, -0.3), (-0.3, -0.3, 0.1, 0.5))


def centred(curve: tuple[float, ...]) -> list[float]:
    """The curve less its mean over time."""
    mean = (sum(curve) - (curve[0] + curve[-1]) / 2) / (len(curve) - 1)
    return [v - mean for v in curve]


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_key, source_size, place (among the weights) and target, from source_key, source and source_size."""
    ranked = running(sizes.withColumns({"one": F.lit(1), "all": F.lit(0), "unnamed": F.col("source").isNull()}), "all", ("unnamed", "source"), "one")
    place = F.pmod("before", F.lit(len(weights))).cast("int")
    table = staged(ranked.select("source_key", "source", "source_size", place.alias("place"), F.get(F.array(*map(F.lit, weights)), place).alias("weight")), "sources")
    limit = F.col("source_size") * most
    whole, weights_of_all = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    left, weight, stopped = whole, weights_of_all, 0
    while True:  # one row to the driver each time
        above = limit * weight < F.lit(left).cast("long") * F.col("weight")  # the words of a corpus may fit an int, times a weight not
        n, given, held = table.filter(above).agg(F.count("*"), F.coalesce(F.sum(limit), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == stopped:
            break
        stopped, left, weight = n, whole - given, weights_of_all - held
    target = F.when(above, limit.cast("double")).otherwise(F.lit(left).cast("double") * F.col("weight") / weight)
    return table.select("source_key", "source", "source_size", "place", target.alias("target"))


def schedules(shares: DataFrame, curves: tuple[tuple[float, ...], ...]) -> DataFrame:
    """shares with rate (a source's share of the mix over its mean, at each knot) and used (the part of its target used up there)."""
    bends = [centred(c) for c in curves]
    knots = range(len(bends[0]))
    bend = lambda k: F.get(F.array(*(F.lit(b[k]) for b in bends)), F.pmod("place", F.lit(len(bends))).cast("int"))
    means = shares.agg(*(F.coalesce(F.sum(F.col("target") * bend(k)) / F.nullif(F.sum("target"), F.lit(0.0)), F.lit(0.0)).alias(f"k{k}") for k in knots)).first()  # a number for each knot
    if any(1 + b[k] - means[k] <= 0 for b in bends for k in knots):
        raise ValueError("curves must leave every source a share at all times")
    step = 1 / (len(bends[0]) - 1)
    rates = [1 + bend(k) - means[k] for k in knots]
    used = list(accumulate(((a + b) * (step / 2) for a, b in zip(rates, rates[1:])), initial=F.lit(0.0)))
    return shares.withColumns({"rate": F.array(*rates), "used": F.array(*used)})


def position_of(used_up: Column) -> Column:
    """The time at which a source has used up this part of its target: the inverse of the integral of its rate."""
    step = 1 / (F.size("rate") - 1)

    def within(k: Column) -> Column:
        a, b, rest = F.get("rate", k), F.get("rate", k + 1), (used_up - F.get("used", k)) / step
        return step * (k + 2 * rest / (a + F.sqrt(F.greatest(a * a + 2 * (b - a) * rest, F.lit(0.0)))))

    knot = F.least(F.size(F.filter("used", lambda u: u <= used_up)), F.size("used") - 1) - 1
    return let(knot, within)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = 3, curves: tuple[tuple[float, ...], ...] = CURVES) -> DataFrame:
    """One row for each occurrence of a document in the mix, and one for a document without any.

    Returns row (a number of the document's own), doc_id, source, size, source_size, target, round (from 0), words
    (taken by this occurrence), position (0 to 1, null without words) and at (the words of the mix before it).
    """
    key = F.coalesce(F.concat(F.lit(":"), "source"), F.lit("-"))
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("tie"),
        F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 16).alias("draw"),
    ).withColumn("source_key", key)
    rows = staged(rows, "sizes")
    sizes = rows.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    plan = staged(schedules(targets(sizes, weights, most), curves), "schedule")
    placed = running(rows, "source_key", ("draw", "doc_id", "size", "tie"), "size", plan.drop("source", "place"))
    begun = F.col("round") * F.col("source_size") + F.col("before")
    each = placed.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("begun", begun)
    words = F.greatest(F.least(F.floor("target") - F.col("begun"), F.col("size")), F.lit(0))
    each = each.withColumn("words", words).filter("words > 0 or round = 0")
    each = each.withColumn("position", F.when(F.col("words") > 0, position_of(F.col("begun") / F.col("target"))))
    each = each.select("row", "doc_id", "source", "size", "source_size", "target", "round", "words", "position", "draw", F.lit(0).alias("all"), F.col("position").isNull().alias("unused"))
    ordered = running(each.withColumnRenamed("row", "own"), "all", ("unused", "position", "draw", "own", "round"), "words")
    return ordered.select(F.col("own").alias("row"), "doc_id", "source", "size", "source_size", "target", "round", "words", "position", F.col("before").alias("at"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The occurrences that have words, range-sorted for training."""
    return mixed.filter("words > 0").repartitionByRange("at").sortWithinPartitions("at")


def by_document(mixed: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted) and copies of every document."""
    grouped = mixed.groupBy("row", "doc_id", "source", "size", "source_size", "target")
    return grouped.agg(F.sum("words").alias("taken"), F.count_if(F.col("words") > 0).alias("copies")).drop("row")
