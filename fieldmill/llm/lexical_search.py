"""Ranked lexical search: the best documents of each query item, by grouping documents with the same matched terms.

1. Every document's occurrences of the items' terms are counted once and written as an index: doc_id, n (all its terms),
   terms, counts. Statistics (documents, lengths, document frequencies) come from the index and cover all documents.
2. Tasks read the index in batches. Each term has a bitmap of the batch's documents. For an item, terms that together
   can't lift a document into its best ones are set aside; the union of the others' bitmaps are the candidates. These are
   grouped by the mask of the terms they hold, and the distinct masks are evaluated in descending order of the score they
   may reach at most, until that falls below the worst of the best found so far. Nothing that could still enter is
   left out, ties included.
3. A task sends the best of each item only, and these are ranked.

Items are read in portions of bounded size, and each portion takes one pass over the documents, so memory doesn't grow
with either table.

Nulls: a null text or item has no terms. A null doc_id comes before all others among equal scores. Rows with the same
doc_id are documents of their own, rows with the same item_id items of their own. An item without a term that any
document holds has no rows; neither has any item if no document has a term.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct_spans, nothing_kept, slices, staged, text_bytes, word_spans

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # ASCII letters and digits, and all beyond ASCII
BLOCK = 1 << 20  # bytes of text that a task looks at together
POSTINGS = 1 << 21  # entries of the index that are scored together
_between = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
INDEX = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "place int, item_id long, doc_id long, score long"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(TERM), 0))


def portions(items: DataFrame, most_terms: int) -> Iterator[list[tuple[int, int | None, list[str]]]]:
    """(place, item_id, terms) of all items, in lists of at most so many terms together, or of one item."""
    held, size = [], 0
    for place, r in enumerate(items.select("item_id", terms_of(F.col("text")).alias("terms")).toLocalIterator()):  # a partition of items at a time
        if held and size + len(r.terms) > most_terms:
            yield held
            held, size = [], 0
        held.append((place, r.item_id, r.terms))
        size += len(r.terms)
    if held:
        yield held


def index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n, and for the words of the vocabulary a document holds their places there and counts."""
    shared = docs.sparkSession.sparkContext.broadcast([w.encode() for w in vocabulary])  # one portion's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        place = {w: k for k, w in enumerate(shared.value)}
        for batch in slices(batches, "text", BLOCK):
            raw, offsets = text_bytes(batch.column("text"))
            raw = _lower[raw]
            start, end = word_spans(raw, offsets, _between)
            doc = np.searchsorted(offsets, start, side="right") - 1
            first, which = distinct_spans(raw, start, end)
            body = raw.tobytes()
            term = np.array([place.get(body[a:b], -1) for a, b in zip(start[first].tolist(), end[first].tolist())], np.int64)[which]
            pairs, counts = np.unique((doc * len(place) + term)[term >= 0], return_counts=True)
            cuts = pa.array(np.searchsorted(pairs, np.arange(batch.num_rows + 1) * len(place)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(place)), counts)]
            n = pa.array(np.bincount(doc, minlength=batch.num_rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


class Batch:
    """Documents of an index batch with their postings by term, and a bitmap of documents for each term."""

    def __init__(self, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, words: int, documents: int, total: int):
        m = 10 + (90 * n * documents) // total
        doc = np.repeat(np.arange(len(n)), lengths)
        order = np.argsort(terms, kind="stable")
        self.doc, tf = doc[order], counts[order].astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])
        self.edge = np.searchsorted(terms[order], np.arange(words + 1))
        held = np.flatnonzero(np.diff(self.edge))
        self.most = np.zeros(words, np.int64)  # the largest impact of each term
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impact, self.edge[held])
        self.bits = np.zeros((words, (len(n) + 7) // 8), np.uint8)
        for a in range(0, len(held), 256):
            some = held[a : a + 256]
            flags = np.zeros((len(some), len(n)), bool)
            flags[np.repeat(np.arange(len(some)), np.diff(self.edge)[some]), self.doc[self.edge[some[0]] : self.edge[some[-1] + 1]]] = True
            self.bits[some] = np.packbits(flags, axis=1)

    def scores(self, docs: np.ndarray, holds: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of documents, of which holds tells the terms."""
        total = np.zeros(len(docs), np.int64)
        for t, w, has in zip(terms.tolist(), weights.tolist(), holds):
            a, b = self.edge[t], self.edge[t + 1]
            total[has] += w * self.impact[a + np.searchsorted(self.doc[a:b], docs[has])]
        return total

    def best(self, terms: np.ndarray, weights: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of an item, among them all that are above 0 and may be among the top best or reach floor, the least score that still counts."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound = weights * self.most[terms]
        order = np.argsort(bound, kind="stable")
        terms, weights, bound = terms[order], weights[order], bound[order]
        useful = int(np.searchsorted(np.cumsum(bound), max(floor, 1)))  # the terms before this one together stay below it
        if useful == len(terms):
            return none
        union = np.unpackbits(np.bitwise_or.reduce(self.bits[terms[useful:]], axis=0))
        docs = np.flatnonzero(union)
        holds = (self.bits[terms][:, docs >> 3] >> (7 - (docs & 7)).astype(np.uint8)) & 1
        masks = np.ascontiguousarray(np.packbits(holds, axis=0).T)
        masks = np.concatenate([masks, np.zeros((len(docs), -masks.shape[1] % 8), np.uint8)], axis=1)
        masks = masks.view(np.uint64)[:, 0] if masks.shape[1] == 8 else masks.view(f"V{masks.shape[1]}")[:, 0]
        _, first, which = np.unique(masks, return_index=True, return_inverse=True)
        reach = bound @ holds[:, first].astype(np.int64)  # what a document of each mask may score at most
        members = np.argsort(-reach[which], kind="stable")  # documents, those of the best mask first
        limit = reach[which][members]
        found, scores, at = [], [], 0
        while at < len(members) and limit[at] >= max(floor, 1):
            stop = at + max(64, 2 * at)
            stop = int(np.searchsorted(-limit, -limit[min(stop, len(members)) - 1], side="right"))  # whole masks
            some = members[at:stop]
            found.append(docs[some])
            scores.append(self.scores(docs[some], holds[:, some].astype(bool), terms, weights))
            known = np.concatenate(scores)
            if len(known) >= top:
                floor = max(floor, int(np.partition(known, -top)[-top]))
            at = stop
        if not found:
            return none
        docs, scores = np.concatenate(found), np.concatenate(scores)
        keep = scores >= max(floor, 1)
        return docs[keep], scores[keep]


def best_of(rows: DataFrame, items: list[tuple[int, int | None, list[int]]], weights: np.ndarray, documents: int, total: int, top: int, postings: int) -> DataFrame:
    """place, item_id, doc_id and score of the best documents of each item in each task, from an index."""
    wanted = [(p, i, np.array([t for t in terms if weights[t] > 0], np.int64)) for p, i, terms in items]
    shared = rows.sparkSession.sparkContext.broadcast(([w for w in wanted if len(w[2])], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        items, weights = shared.value
        kept: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]

        def look(part: pa.RecordBatch) -> None:
            n, ids = part.column("n").to_numpy(), part.column("doc_id")
            own, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            lengths = part.column("terms").value_lengths().to_numpy()
            batch = Batch(n, lengths, *(part.column(c).flatten().to_numpy() for c in ("terms", "counts")), len(weights), documents, total)
            for k, (_, _, terms) in enumerate(items):
                score, valid, id_ = kept[k]
                docs, found = batch.best(terms, weights[terms], top, int(score[-1]) if len(score) == top else 0)
                if len(docs):
                    score, valid, id_ = np.append(score, found), np.append(valid, known[docs]), np.append(id_, own[docs])
                    order = np.lexsort((id_, valid, -score))[:top]
                    kept[k] = score[order], valid[order], id_[order]

        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.cumsum(batch.column("terms").value_lengths().to_numpy()) // postings
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                look(batch.slice(a, b - a))
        out = [(p, i, int(d) if v else None, int(s)) for (p, i, _), (scores, valid, docs) in zip(items, kept) for s, v, d in zip(scores, valid, docs)]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], ["place", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, *, top: int = 10, most_terms: int = 16_384, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's best documents with a score above 0, equal scores by ascending doc_id.

    docs has doc_id and text, items item_id and text; other columns take no part.
    """
    spark, parts = docs.sparkSession, []
    for portion in portions(items, most_terms):
        vocabulary = list(dict.fromkeys(t for _, _, terms in portion for t in terms))
        place = {t: k for k, t in enumerate(vocabulary)}
        rows = staged(index(docs, vocabulary), "search-index")
        documents, total = rows.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            continue
        found = {r.term: r.df for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator()}  # one portion's terms
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * found[k] + 1))) if k in found else 0 for k in range(len(vocabulary))], np.int64)
        parts.append(best_of(rows, [(p, i, [place[t] for t in terms]) for p, i, terms in portion], weights, documents, total, top, postings))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    some = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).withColumn("rank", best("place", "salt")).filter(F.col("rank") <= top)
    return some.withColumn("rank", best("place")).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
