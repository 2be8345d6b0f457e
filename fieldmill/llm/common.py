"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: the six ASCII characters.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
_is_space = np.zeros(256, bool)
_is_space[list(SPACE_BYTES)] = True
_low_bytes = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none and runs on this machine alone (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_dirs:
            _local_dirs[app] = f"file://{tempfile.mkdtemp(prefix='spark-fieldmill-')}"
        at = _local_dirs[app]
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    plain = F.coalesce(text, F.lit(""))
    for other in "\t\n\x0b\x0c\r":  # plain replacement and a one-character separator take a third of a pattern's time
        plain = F.replace(plain, F.lit(other), F.lit(" "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n, off = len(column), column.offset
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[off : off + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about max_bytes of one string column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.diff(text_bytes(batch.column(column))[1])
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def word_spans(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _is_space) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes other than those between words (ASCII white space); none reaches across the end of a text."""
    word = ~between[raw]
    begins = np.append(True, ~word[:-1])[: len(word)]
    begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
    stops = np.append(begins[1:] | ~word[1:], True)[: len(word)]
    return np.flatnonzero(begins & word), np.flatnonzero(stops & word) + 1


def distinct_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): the place in start of one span of each kind, and the kind of every span.

    Spans of up to 24 bytes are of one kind if they are equal, compared as three numbers and a length; a hash only
    decides which ones are compared. Longer ones are kinds of their own.
    """
    n = end - start
    padded = np.append(raw, np.zeros(24, np.uint8))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each position on
    parts = [eight[np.minimum(start + 8 * k, len(raw) + 16)] & _low_bytes[np.clip(n - 8 * k, 0, 8)] for k in range(3)]
    order = np.argsort(mix(parts[0] + mix(parts[1] + mix(parts[2] + n.astype(np.uint64)))))
    new = np.append(True, n[order][1:] != n[order][:-1])[: len(n)] | (n[order] > 24)
    for p in parts:
        new[1:] |= p[order][1:] != p[order][:-1]
    which = np.empty(len(n), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def gathered(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[start : start + n] of every span, end to end."""
    before = np.cumsum(n) - n
    return values[np.repeat(start - before, n) + np.arange(int(n.sum()))]


class Table:
    """A bounded memory of arrays by word: the words' arrays lie end to end in values, at start with length size.

    When it is full, words that weren't asked for again since the last time it was are dropped, and remember words at
    most are kept; it is full again with half as many new ones.
    """

    def __init__(self, remember: int, kind: str, learn: Callable[[list[bytes]], list[bytes]]):
        self.remember, self.limit, self.learn = remember, remember, learn
        self.known: dict[bytes, int] = {}
        self.values, self.start, self.size, self.used = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word; learn gives the values of words met for the first time, as bytes."""
        if len(self.known) > self.limit:
            self._drop()
        at = list(map(self.known.get, words))
        self.used[[k for k in at if k is not None]] = True
        new = list(dict.fromkeys(w for w, k in zip(words, at) if k is None))
        if new:
            found = self.learn(new)
            self.known |= zip(new, range(len(self.start), len(self.start) + len(new)))
            size = np.fromiter(map(len, found), np.int64, len(found)) // self.values.itemsize
            self.start = np.concatenate([self.start, len(self.values) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.values = np.concatenate([self.values, np.frombuffer(b"".join(found), self.values.dtype)])
            self.used = np.concatenate([self.used, np.zeros(len(new), bool)])
            at = [self.known[w] if k is None else k for w, k in zip(words, at)]
        return np.array(at, np.int64)

    def _drop(self) -> None:
        keep = np.flatnonzero(self.used)[-self.remember :]
        self.limit = max(self.remember, len(keep) + self.remember // 2)
        place = np.full(len(self.used), -1)
        place[keep] = np.arange(len(keep))
        self.known = {w: k for w, k in zip(self.known, place[list(self.known.values())].tolist()) if k >= 0}
        self.values = gathered(self.values, self.start[keep], self.size[keep])
        self.size = self.size[keep]
        self.start = np.cumsum(self.size) - self.size
        self.used = np.zeros(len(keep), bool)

    def of_spans(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All spans' values end to end, and how many each span has."""
        first, which = distinct_spans(raw, start, end)
        body = raw.tobytes()
        at = self.places([body[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])[which]
        return gathered(self.values, self.start[at], self.size[at]), self.size[at]


_kept: dict = {}
_libc = ctypes.CDLL(None)


def _give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a worker process keeps for its next tasks: one thing at a time, the last that a task asked for."""
    if key not in _kept:
        nothing_kept()
        _kept[key] = make()
    return _kept[key]


def nothing_kept() -> None:
    """Frees what earlier tasks left in this worker process."""
    _kept.clear()
    _give_back()


class Memory(dict):
    """A bounded memory of computed values: when it is full, values that weren't used since the last time it was are dropped."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def missing(self, *groups: list[str], more: bool = False) -> list[str]:
        """The keys among groups without a value; all others have theirs here afterwards. With more, the last call's stay too."""
        if len(self) > self.size and not more:
            self.old = dict(self)
            self.clear()
        new = []
        for k in [k for k in set().union(*groups) if k not in self]:
            value = self.old.get(k)
            if value is None:
                new.append(k)
            else:
                self[k] = value
        return new


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads the bits of h (uint64) over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, np.uint64(base), dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of (raw[j] + 1) * base**j over j < i, modulo 2**64."""
    h = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw))[0], out=h[1:])
    return h


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), alike for equal bytes wherever they stand."""
    return (h[end] - h[start]) * powers(len(h))[1][start]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key, a number that orders rows as doc_id does and tells all rows apart.

    key is doc_id itself where that is unique and never null (then this costs one narrow shuffle of ids). Otherwise
    the rows are written once, ordered by doc_id (null first) and text, and numbered.
    """
    ids = docs.groupBy(F.col("doc_id").alias("id")).count().filter("count > 1 or id is null")
    if ids.isEmpty():
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    ordered = docs.repartitionByRange(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return staged(ordered.withColumn("key", F.monotonically_increasing_id()), "keyed")


def running(rows: DataFrame, group: str, order: tuple[str, ...], value: str, groups: DataFrame | None = None) -> DataFrame:
    """rows with before (the sum of value over the earlier rows of their group, in the order given, nulls first), total (their group's) and row (a number of their own).

    group is never null. Rows are dealt by ranges of group and order and written, so a group of any size is spread over
    many ranges: sums run within a range, and the ranges' own sums give each its start. groups may bring further
    columns for each group; they come with those starts, so that no join has all rows of a group on one key.
    """
    by = [F.asc_nulls_first(c) for c in (group, *order)]
    ranged = staged(rows.repartitionByRange(*by).withColumns({"_range": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "ranges")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range", group).agg(F.sum(value).alias("_sum"))  # a row for each range, and one more for each group that begins in it
    starts = sums.withColumns({"_start": F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy(group).orderBy("_range"))), F.lit(0)), "total": F.sum("_sum").over(Window.partitionBy(group))})
    if groups is not None:
        starts = starts.join(groups, group)
    own = Window.partitionBy("_range", group).orderBy(*by[1:], "row")
    within = ranged.withColumn("before", F.coalesce(F.sum(value).over(earlier(own)), F.lit(0)))
    found = within.join(starts.drop("_sum"), ["_range", group])
    return found.withColumn("before", F.col("before") + F.col("_start")).drop("_range", "_start")


def compressed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns named and z, the text's bytes compressed, for shuffles that carry whole texts."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in slices(batches, "text", 1 << 22):
            z = pa.array([press.compress((t.as_py() or "").encode()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), z], [*columns, "z"])

    return docs.select(*columns, "text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "z binary"]))
