"""Removal of repeated passages: every byte of a string of so many bytes that also starts earlier in the corpus.

Each window (a string of the given length) is filed under its smallest hash of a short piece inside it, so equal
windows are filed alike wherever they stand, and neighbouring windows mostly share one file. A run of neighbouring
windows with one file is a segment, the unit of the first round:

1. Blocks of documents: segments that share a file are suffix-sorted. The sort is a mergesort whose comparisons find the
   common extension of two suffixes by binary search over prefix polynomial hashes; neighbours that come out equal are
   compared byte by byte. All but the first of equal segments are repeats, and one of each goes on. Windows within a
   segment are told apart alike: hashes bring them together, bytes decide.
2. The segments of all blocks meet by file, sorted, and stream past: all but the first of equal ones are repeats. Equal
   is here who has the file and, verified on all its bytes, the BLAKE2b digest of another. A segment that shares its
   file with different ones only has to be looked at window by window.
3. Those few are read again. Their bytes meet by file, and windows with the same hashes are compared byte by byte. Where a
   file has more kinds than a task should hold, windows instead of segments are sent, under 128 bits of their BLAKE2b
   digests, and meet as segments did before.
4. Each document's repeats are joined with its text and cut out.

A block sends one segment of each kind at most, so a passage that a third of all documents hold, or thousands of copies,
are as many rows as there are blocks. Nothing is held for a whole group anywhere.

Nulls: a null text is empty. Rows with equal or null doc_id count as documents of their own, ordered by id (null
first) and then by text. Matches never cross documents; a document below the window's length loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compressed, keyed, mix, nothing_kept, powers, prefix_hashes, slices, span_hashes, staged, text_bytes

BLOCK = 1 << 19  # bytes of text that a task looks at together
LONG = 1 << 20  # longer documents are cut, with an overlap
SHIFT = 24  # a position and a count in one number; a count stays below 2**24
SEGMENT = "file long, sum long, key long, place long"
FOUND = "key long, start long, n long, repeat boolean, file long"


class Suffixes:
    """Suffixes of a byte string with limits, compared by their common extension."""

    def __init__(self, raw: np.ndarray, hashes: np.ndarray):
        self.raw, self.h, self.p = raw.tobytes(), memoryview(hashes), memoryview(powers(len(hashes))[0])

    def common(self, a: int, b: int, limit: int) -> int:
        """The length of the common extension of the suffixes at a and b, at most limit."""
        if a > b:
            a, b = b, a
        h, power, ha, hb = self.h, self.p[b - a], self.h[a], self.h[b]
        low, high, at = 0, limit, limit  # the whole length first: equal segments are the usual case
        while low < high:
            if ((h[a + at] - ha) * power - (h[b + at] - hb)) & 0xFFFFFFFFFFFFFFFF:
                high = at - 1
            else:
                low = at
            at = (low + high + 1) // 2
        if self.raw[a : a + low] == self.raw[b : b + low]:
            return low
        return next(k for k in range(low) if self.raw[a + k] != self.raw[b + k])  # different bytes of one hash

    def compare(self, x: tuple[int, int], y: tuple[int, int]) -> int:
        """The order of two suffixes (start, limit): by bytes, then the shorter first."""
        (a, m), (b, n) = x, y
        k = self.common(a, b, min(m, n))
        return m - n if k == min(m, n) else self.raw[a + k] - self.raw[b + k]

    def classes(self, suffixes: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        """Groups of equal suffixes, by sorting; equality is verified on the bytes."""
        group: list[tuple[int, int]] = []
        for s in sorted(suffixes, key=cmp_to_key(self.compare)):
            if group and self.raw[s[0] : sum(s)] == self.raw[group[0][0] : sum(group[0])]:
                group.append(s)
            else:
                if group:
                    yield group
                group = [s]
        if group:
            yield group


def sliding(choose: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """choose (np.minimum or np.maximum) over each stretch of width values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = choose(values[:-step], values[step:])
        done += step
    return values


def segments(raw: np.ndarray, offsets: np.ndarray, window: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, file, whether windows may repeat inside it, prefix hashes) of the segments of documents laid end to end.

    A window can come twice in one segment only if the piece that names the file does, not further apart than a window
    has pieces.
    """
    h = prefix_hashes(raw)
    last = len(raw) - window + 1
    if last <= 0:
        return (*(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, np.uint64), np.zeros(0, bool), h)
    hashes = mix((h[piece:] - h[:-piece]) * powers(len(h))[1][: len(h) - piece])
    width = window - piece + 1
    low = sliding(np.minimum, hashes, width)
    edge = np.zeros(width - 1, np.uint64)
    names = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, low, edge]), width) == hashes)
    names = names[np.argsort(hashes[names], kind="stable")]
    twice = hashes[names[1:]][(hashes[names[1:]] == hashes[names[:-1]]) & (names[1:] - names[:-1] <= width)]
    ends = np.repeat(offsets[1:], np.diff(offsets))[:last]
    whole = np.arange(last) + window <= ends
    begins = np.append(True, (low[1:] != low[:-1]) | ~whole[:-1] | (ends[1:] != ends[:-1])) & whole
    start = np.flatnonzero(begins)
    stops = np.append(np.flatnonzero(begins | ~whole), last)
    n = stops[np.searchsorted(stops, start, side="right")] - start
    return start, n, low[start], np.isin(low[start], twice), h


def runs(key: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the intervals of each key, as (key, start, length) in order; intervals that touch are one."""
    if not len(key):
        return key, start, length
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], (start + length)[order]
    new_key = np.append(True, key[1:] != key[:-1])
    reach = np.maximum.accumulate(stop + np.cumsum(new_key) * (1 << 44)) - np.cumsum(new_key) * (1 << 44)
    new = np.append(True, new_key[1:] | (start[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return key[first], start[first], np.append(reach[first[1:] - 1], reach[-1]) - start[first]


def _rows(file: np.ndarray, total: np.ndarray, key: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    place = (start.astype(np.int64) << SHIFT) | n.astype(np.int64)
    arrays = [file.astype(np.uint64).view(np.int64), total.astype(np.uint64).view(np.int64), key.astype(np.int64), place]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["file", "sum", "key", "place"])


def _found(key: np.ndarray, start: np.ndarray, n: np.ndarray, file: np.ndarray | None = None) -> pa.RecordBatch:
    """Repeats, or with a file segments to look at."""
    arrays = [pa.array(key), pa.array(start), pa.array(n), pa.array(np.full(len(key), file is None)), pa.nulls(len(key), pa.int64()) if file is None else pa.array(file)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "start", "n", "repeat", "file"])


def _repeats(key: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Repeats found within a block: rows whose count is 0 and whose sum is their length."""
    key, start, length = runs(key, start, length)
    return _rows(mix(key.astype(np.uint64)), length, key, start, np.zeros(len(key), np.int64))


def _documents(batches: Iterator[pa.RecordBatch], window: int, block: int, long: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, keys, position of the first byte) of blocks of documents; only long ones don't start at 0."""
    for batch in slices(batches, "text", block):
        raw, offsets = text_bytes(batch.column("text"))
        keys = batch.column("key").to_numpy()
        if len(raw) <= long:
            yield raw, offsets, keys, 0
            continue
        for a, b, key in zip(offsets[:-1].tolist(), offsets[1:].tolist(), keys):
            for at in range(a, max(a + 1, b - window + 1), long):
                part = raw[at : min(b, at + long + window - 1)]
                yield part, np.array([0, len(part)]), np.array([key]), at - a


def halves(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window: of its first half and of its second."""
    half = at + window // 2
    return mix(span_hashes(h, at, half)), mix(span_hashes(h, half, at + window) + np.uint64(1))


def repeated(raw: np.ndarray, at: np.ndarray, window: int, group: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """Which of the windows at these places equal an earlier one in the list that has the same group.

    Hashes bring equal windows together; each is then compared, byte by byte, with the first that has its hashes, and
    where bytes differ all of that first one's windows are told apart by their bytes.
    """
    again = np.zeros(len(at), bool)
    if len(at) < 2:
        return again
    one, two = halves(prefix_hashes(raw) if h is None else h, at, window)
    order = np.lexsort((np.arange(len(at)), two, one, group))
    new = np.append(True, (group[order][1:] != group[order][:-1]) | (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))][~new]
    later = order[~new]
    views = np.lib.stride_tricks.sliding_window_view(raw, window)
    for a in range(0, len(later), 1 << 15):
        again[later[a : a + (1 << 15)]] = (views[at[later[a : a + (1 << 15)]]] == views[at[first[a : a + (1 << 15)]]]).all(axis=1)
    odd = np.isin(first, first[~again[later]])
    for leader in np.unique(first[odd]).tolist():
        seen = {raw[at[leader] : at[leader] + window].tobytes()}
        for k in later[first == leader].tolist():
            body = raw[at[k] : at[k] + window].tobytes()
            again[k] = body in seen
            seen.add(body)
    return again


def block_segments(docs: DataFrame, window: int, piece: int, block: int, long: int) -> DataFrame:
    """Round 1: of each block, one of each kind of segment, and the repeats among its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for raw, offsets, keys, base in _documents(batches, window, block, long):
            start, n, file, inner, h = segments(raw, offsets, window, piece)
            if not len(start):
                continue
            doc = np.searchsorted(offsets, start, side="right") - 1
            key, at = keys[doc], start - offsets[doc] + base
            length = n + window - 1
            order = np.argsort(file, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, file[order][1:] != file[order][:-1])), len(order))
            repeat = np.zeros(len(start), bool)
            suffixes = Suffixes(raw, h)
            where = dict(zip(start.tolist(), range(len(start))))
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 1:
                    members = order[a:b]
                    for same in suffixes.classes(list(zip(start[members].tolist(), length[members].tolist()))):
                        if len(same) > 1:
                            own = [where[s] for s, _ in same]
                            first = min(own, key=lambda i: (key[i], at[i]))
                            repeat[[i for i in own if i != first]] = True
            new = ~repeat
            body = suffixes.raw
            digests = b"".join(hashlib.blake2b(body[a:b], digest_size=8).digest() for a, b in zip(start[new].tolist(), (start + length)[new].tolist()))
            yield _rows(file[new], np.frombuffer(digests, np.uint64), key[new], at[new], n[new])
            if repeat.any():
                yield _repeats(key[repeat], at[repeat], length[repeat])
            if inner.any():
                own = np.repeat(np.flatnonzero(inner), n[inner])
                k = np.arange(len(own)) - np.repeat(np.cumsum(n[inner]) - n[inner], n[inner])
                again = np.flatnonzero(repeated(raw, start[own] + k, window, own, h))
                yield _repeats(key[own[again]], at[own[again]] + k[again], np.full(len(again), window, np.int64))

    return docs.select("key", "text").mapInArrow(run, SEGMENT)


class Stream:
    """Rows that come ordered by file, sum, key and place: repeats, and the firsts of kinds that share a file with others.

    It keeps the last file and sum, and the first row of that file while it is the only kind.
    """

    def __init__(self, window: int):
        self.window, self.last = window, None

    def out(self, key: np.ndarray, place: np.ndarray, file: np.ndarray | None = None) -> pa.RecordBatch:
        start, n = place >> SHIFT, place & ((1 << SHIFT) - 1)
        if file is None:
            return _found(*runs(key, start, n + self.window - 1))
        return _found(key, start, n, file)

    def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        file, total, key, place = (batch.column(c).to_numpy() for c in range(4))
        known = (place & ((1 << SHIFT) - 1)) == 0
        if known.any():
            yield _found(key[known], place[known] >> SHIFT, total[known])
            file, total, key, place = file[~known], total[~known], key[~known], place[~known]
        if not len(file):
            return
        same_file = np.append(bool(self.last and self.last[0] == file[0]), file[1:] == file[:-1])
        same = same_file & np.append(bool(self.last and self.last[0] == file[0] and self.last[1] == total[0]), total[1:] == total[:-1])
        if same.any():
            yield self.out(key[same], place[same])
        first = np.flatnonzero(~same)  # the first of each kind
        opens = ~same_file[first]  # the first of each file
        if len(first):
            more = np.append(~opens[1:], False)  # the next kind has the same file
            if self.last and self.last[2] and not opens[0]:
                yield self.out(np.array([self.last[2][0]]), np.array([self.last[2][1]]), np.array([self.last[0]]))
            look = first[~opens | more]
            if len(look):
                yield self.out(key[look], place[look], file[look])
            alone = opens[-1]
            self.last = (file[-1], total[-1], (key[first[-1]], place[first[-1]]) if alone else None)
        else:
            self.last = (file[-1], total[-1], self.last[2] if self.last else None)


def meet(rows: DataFrame, window: int) -> DataFrame:
    """Round 2: segments with one file stream past in order."""
    ordered = rows.repartition("file").sortWithinPartitions("file", "sum", "key", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(window)
        for batch in batches:
            yield from stream.rows(batch)

    return ordered.mapInArrow(run, FOUND)


def unpacked(batch: pa.RecordBatch, column: str = "z") -> list[bytes]:
    import zstandard

    undo = zstandard.ZstdDecompressor()
    return [undo.decompress(z.as_py()) for z in batch.column(column)]


def closer_rows(texts: DataFrame, looks: DataFrame, window: int, most: int, block: int) -> DataFrame:
    """Round 3's rows: segments with their bytes, and the windows of segments whose file has more than most kinds."""
    hot = looks.groupBy("file").count().filter(F.col("count") > most).select("file", F.lit(True).alias("hot"))
    marked = looks.join(hot, "file", "left").select("key", F.struct("start", "n", "file", F.coalesce("hot", F.lit(False)).alias("hot")).alias("look"))
    each = marked.groupBy("key").agg(F.collect_list("look").alias("looks"))  # bounded by the document's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(batch: pa.RecordBatch, data: pa.Array | None = None) -> pa.RecordBatch:
            data = pa.nulls(batch.num_rows, pa.binary()) if data is None else data
            return pa.RecordBatch.from_arrays([*batch.columns, data], [*batch.schema.names, "bytes"])

        def windows(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            parts = sorted(parts, key=lambda p: p[0])  # keys are in the order of documents
            raw = np.concatenate([p[2] for p in parts])
            base = np.cumsum([0, *(len(p[2]) for p in parts[:-1])])
            key = np.concatenate([np.full(len(p[1]), p[0], np.int64) for p in parts])
            start = np.concatenate([p[1] for p in parts])
            at = np.concatenate([p[1] + b for p, b in zip(parts, base)])
            again = repeated(raw, at, window, np.zeros(len(at), np.int64))
            new, body, digests = ~again, memoryview(raw), bytearray(16 * int((~again).sum()))
            for k, a in enumerate(at[new]):
                digests[16 * k : 16 * k + 16] = hashlib.blake2b(body[a : a + window], digest_size=16).digest()
            digests = np.frombuffer(digests, np.uint64)
            yield given(_rows(digests[::2], digests[1::2], key[new], start[new], np.ones(new.sum(), np.int64)))
            if again.any():
                yield given(_repeats(key[again], start[again], np.full(again.sum(), window, np.int64)))

        parts, size = [], 0
        for batch in slices(batches, "z", block):
            cold: list[tuple] = []
            for text, key, look in zip(unpacked(batch), batch.column("key").to_pylist(), batch.column("looks").to_pylist()):
                cold += [(x["file"], 0, key, x["start"] << SHIFT | x["n"], text[x["start"] : x["start"] + x["n"] + window - 1]) for x in look if not x["hot"]]
                if hot_ones := [np.arange(x["start"], x["start"] + x["n"]) for x in look if x["hot"]]:
                    parts.append((key, np.sort(np.concatenate(hot_ones)), np.frombuffer(text, np.uint8)))
                    size += len(parts[-1][1]) + len(text)
                if size > 500_000:
                    yield from windows(parts)
                    parts, size = [], 0
            if cold:
                kinds = [*(pa.int64() for _ in range(4)), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cold), kinds)], ["file", "sum", "key", "place", "bytes"])
        if parts:
            yield from windows(parts)

    return texts.join(each, "key").select("key", "z", "looks").mapInArrow(run, SEGMENT + ", bytes binary")


def closer(rows: DataFrame, window: int) -> DataFrame:
    """Round 3: which windows of segments that share a file are repeats. Windows that come singly are told apart like segments."""
    ordered = rows.repartition("file").sortWithinPartitions("file", "sum", "key", "place")

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        file, key, place = (batch.column(c).to_numpy() for c in ("file", "key", "place"))
        raw, offsets = text_bytes(batch.column("bytes"))
        n = place & ((1 << SHIFT) - 1)
        own = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        start = (place >> SHIFT)[own] + k
        order = np.lexsort((start, key[own]))
        again = order[repeated(raw, (offsets[:-1][own] + k)[order], window, file[own][order])]
        return _found(*runs(key[own[again]], start[again], np.full(len(again), window, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cuts(file: np.ndarray, place: np.ndarray, most: int = 200_000) -> Iterator[tuple[int, int]]:
            """Whole files, of about so many windows together or one."""
            windows, at = np.cumsum(place & ((1 << SHIFT) - 1)), 0
            while at < len(file):
                reach = int(np.searchsorted(windows, (windows[at - 1] if at else 0) + most))
                end = len(file) if reach >= len(file) else int(np.searchsorted(file, file[reach], side="left"))
                end = end if end > at else int(np.searchsorted(file, file[at], side="right"))
                yield at, end - at
                at = end

        nothing_kept()
        stream, held = Stream(window), None
        for batch in batches:
            one = pa.compute.is_null(batch.column("bytes"))
            yield from stream.rows(batch.filter(one).select(["file", "sum", "key", "place"]))
            rest = batch.filter(pa.compute.invert(one))
            held = rest if held is None else pa.concat_batches([held, rest])
            file = held.column("file").to_numpy()
            whole = int(np.searchsorted(file, file[-1])) if len(file) else 0  # the last file may go on
            for at in cuts(file[:whole], held.column("place").to_numpy()[:whole]):
                yield compared(held.slice(*at))
            held = held.slice(whole)
        if held is not None and held.num_rows:
            yield compared(held)

    return ordered.mapInArrow(run, FOUND)


def repeats(docs: DataFrame, *, window: int = 100, piece: int = 28, most: int = 5000, block: int = BLOCK, long: int = LONG) -> DataFrame:
    """key, start, n: intervals of bytes to remove, which may overlap, for docs with key and text."""
    found = staged(meet(block_segments(docs, window, piece, block, long), window), "segments")
    looks = found.filter("not repeat").select("file", "key", "start", "n")
    near = closer(closer_rows(compressed(docs, "key"), looks, window, most, block), window).filter("repeat")
    return found.filter("repeat").unionByName(near).select("key", "start", "n")


def dedup(docs: DataFrame, *, window: int = 100, piece: int = 28, columns: tuple[str, ...] = ("doc_id",), most: int = 5000, block: int = BLOCK, long: int = LONG) -> DataFrame:
    """The columns named, and n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes as text).

    most, block and long bound what a task looks at together: kinds of a file, bytes of a block, bytes of a document before it is cut.

    Bytes of a character that is cut in two become U+FFFD in kept, but not in kept_sha256.
    """
    rows = keyed(docs)
    cuts = repeats(rows, window=window, piece=piece, most=most, block=block, long=long).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    whole = compressed(rows, "key", *columns).join(cuts, "key", "left").select(*columns, "z", "cuts")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "z", block):
            out = []
            for text, cut in zip(unpacked(batch), batch.column("cuts").to_pylist()):
                spans = []
                if cut:
                    start, n = (np.array([c[k] for c in cut], np.int64) for k in ("start", "n"))
                    _, start, n = runs(np.zeros(len(cut), np.int64), start, n)
                    spans = list(zip(start.tolist(), (start + n).tolist()))
                at, parts = 0, []
                for a, b in spans:
                    parts.append(text[at:a])
                    at = b
                kept = b"".join([*parts, text[at:]])
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds_)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *arrays], [*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"])
    return whole.mapInArrow(run, kind)
