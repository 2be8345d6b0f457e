"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so the whole corpus is described by how many pieces have each length.
The plan is made from that histogram alone: pieces above one third of the capacity (at most two of them fit together)
are matched greedily, the longest first with the longest partner that fits, and all others go where the least room is
left. A plan row says that so many pieces of one length go to so many consecutive sequences at one offset; its size
depends on the capacity, not on the corpus. Each piece finds its place from its rank among the pieces of its length,
and ranks come from counts per block of documents, so no task gathers the pieces of a common length.

Nulls: a null text is empty and consists of the end token alone. Ties between pieces of one length go by document and
piece; rows with equal doc_id are separate documents.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import SPACE_BYTES, Table, kept, slices, staged, text_bytes, word_spans

PIECES = "doc_id long, doc_row long, piece int, start long, length long, ids_crc32 long"
BLOCK = 1 << 20  # bytes of text that are encoded together
BLOCK_PIECES = 200_000  # of one length that are ranked together, at most in the mean
#: Plain words, in lower case: the letters of most Latin scripts, digits, and the marks that begin no special token.
LETTERS, MARKS = "a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f", r"!-,./:;=?@\[-`{}~-"


def stretches(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about BLOCK bytes, cut at white space."""
    while len(raw) > 2 * BLOCK:
        at = next((BLOCK + k + int(s[0]) for k in range(0, len(raw) - BLOCK, BLOCK) if len(s := np.flatnonzero(np.isin(raw[BLOCK + k : 2 * BLOCK + k], list(SPACE_BYTES))))), len(raw))
        yield raw[:at]
        raw = raw[at:]
    yield raw


class WordEncoder:
    """Token ids of texts; words between ASCII white space are encoded once and remembered.

    That is exact for tokenizers that drop white space and whose normalization doesn't reach across it. Plain words are
    parted here as the tokenizer's own pattern does it, and parts met for the first time are encoded in one call; the
    tokens that end a part tell where to cut. All other words go to the tokenizer as they are.
    """

    def __init__(self, path: str, remember: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        mark = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True
        self.plain = re.compile(f"[{LETTERS}0-9{MARKS}]+")
        self.part = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[{MARKS}]+")
        self.parts: dict[str | bytes, bytes] = {}
        self.remember = remember
        self.words = Table(remember, "<u4", self.learn)

    def split(self, word: bytes) -> str | bytes | list[str]:
        """The part or parts of a word, or the word itself if the tokenizer is to part it."""
        text = word.decode("utf-8", "replace").lower()
        if text.isascii() and text.isalpha():
            return text
        return self.part.findall(text) if self.plain.fullmatch(text) else word

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, as bytes."""
        if len(self.parts) > self.remember:
            self.parts.clear()
        parts, split = self.parts, list(map(self.split, words))
        several = [p for s in split if isinstance(s, list) for p in s]
        new = {p for p in (*several, *(s for s in split if not isinstance(s, list))) if p not in parts}
        plain = [p for p in new if isinstance(p, str)]
        whole = [p for p in new if isinstance(p, bytes)]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        edges = np.flatnonzero(self.ends[ids]) + 1
        if len(edges) == len(plain):
            body, edges = ids.tobytes(), (4 * edges).tolist()
            parts |= zip(plain, (body[a:b] for a, b in zip([0, *edges], edges)))
        else:  # a tokenizer that parts plain words in another way
            whole += plain
        texts = [p if isinstance(p, str) else p.decode("utf-8", "replace") for p in whole]
        for p, e in zip(whole, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            parts[p] = np.array(e.ids, "<u4").tobytes()
        return [b"".join([parts[p] for p in s]) if isinstance(s, list) else parts[s] for s in split]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of UTF-8 bytes laid end to end."""
        if len(raw) <= 2 * BLOCK:
            return self._encode(raw, offsets)
        return [np.concatenate([self._encode(part, np.array([0, len(part)]))[0] for part in stretches(raw[a:b])]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]

    def _encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        start, end = word_spans(raw, offsets)
        ids, n = self.words.of_spans(raw, start, end)
        return np.split(ids, np.append(0, np.cumsum(n))[np.searchsorted(start, offsets[1:-1])]) if len(offsets) > 1 else []


def encoder(path: str) -> WordEncoder:
    """A worker's own encoder, kept for its next tasks."""
    return kept(("packing", path), lambda: WordEncoder(path))


def pieces(docs: DataFrame, path: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32. doc_row tells rows of equal doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", BLOCK):
            out: list[tuple] = []
            for doc_id, doc_row, ids in zip(batch.column("doc_id").to_pylist(), batch.column("doc_row").to_pylist(), own.encode(*text_bytes(batch.column("text")))):
                ids = ids.tobytes() + end
                for k in range(-(-len(ids) // (4 * capacity))):
                    part = ids[4 * capacity * k : 4 * capacity * (k + 1)]
                    out.append((doc_id, doc_row, k, capacity * k, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "doc_row", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("doc_row"), "text")
    return rows.mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first sequence, offset) that place counts[length] pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    taken = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # by room left: ranges of sequences (first, how many)
    rooms: list[int] = []
    next_sequence = 0

    def put(length: int, n: int, sequence: int, room_before: int) -> None:
        rows.append((length, taken[length], n, sequence, capacity - room_before))
        taken[length] += n
        left[length] -= n
        if rest := room_before - length:
            if rest not in room:
                room[rest] = []
                insort(rooms, rest)
            room[rest].append((sequence, n))

    def use(size: int, most: int) -> tuple[int, int]:
        """Takes a range of at most so many sequences that have this room left."""
        first, n = room[size].pop()
        if n > most:
            room[size].append((first + most, n - most))
            n = most
        if not room[size]:
            del room[size]
            rooms.remove(size)
        return first, n

    def opened(length: int, n: int) -> int:
        nonlocal next_sequence
        first = next_sequence
        next_sequence += n
        put(length, n, first, capacity)
        return first

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:  # greedy matching of large pieces, two at most in a sequence
        while left[length]:
            partner = next((p for p in large if p <= capacity - length and p <= length and left[p] > (p == length)), None)
            if partner is None:
                opened(length, left[length])
            else:
                n = left[length] // 2 if partner == length else min(left[length], left[partner])
                first = opened(length, n)
                size = capacity - length
                if size in room and room[size] and room[size][-1] == (first, n):
                    use(size, n)
                put(partner, n, first, size)
    for length in sorted((n for n in left if left[n]), reverse=True):  # the others best-fit
        while left[length]:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                size = rooms[at]
                first, n = use(size, left[length])
                put(length, n, first, size)
            else:  # a new sequence takes as many of this length as fit
                each = capacity // length
                full, rest = divmod(left[length], each)
                if full:
                    first = opened(length, full)
                    size = capacity - length
                    for _ in range(each - 1):
                        use(size, full)
                        put(length, full, first, size)
                        size -= length
                if rest:
                    opened(length, rest if each == 1 else 1)
    return rows


def ranked(parts: DataFrame, blocks: int) -> DataFrame:
    """parts with rank, the number from 0 of each piece among those of its length; each length is cut into so many blocks."""
    cut = parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "doc_row"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("length", "block").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "doc_row", "piece")) - 1
    return cut.withColumn("inside", inside).join(starts.drop("n"), ["length", "block"]).withColumn("rank", F.col("base") + F.col("inside"))


def pack(docs: DataFrame, path: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """pieces with sequence_id and offset; the last but one step before the result is the written table of pieces."""
    spark = docs.sparkSession
    parts = staged(pieces(docs, path, capacity=capacity, end_id=end_id), "pieces")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    rows = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    lengths, first = np.unique(rows[:, 0], return_index=True)
    shared = spark.sparkContext.broadcast((rows, dict(zip(lengths.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(rows)])))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                a, b = at[n]
                own = length == n
                row[own] = a + np.searchsorted(table[a:b, 1], rank[own], side="right") - 1
            sequence = table[row, 3] + rank - table[row, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(sequence), pa.array(table[row, 4])], names)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    blocks = max(64, sum(counts.values()) // BLOCK_PIECES)  # however common a length is, its blocks stay small
    return ranked(parts, blocks).mapInArrow(place, kind)
