"""Byte-level BPE encoding and decoding with a lexicon of frequent words.

The corpus's frequent words are compiled into a minimal acyclic transducer: states with equal futures are shared, and
the outputs summed along a word's path give its place in a table of token ids. The compiled lexicon is one block of
bytes of bounded size that workers map into memory. A word outside it is merged exactly, pair by pair in rank order.

Nulls and empty texts have no tokens; rows are coded each by itself, whatever their ids are. Text of any length is cut into words first, and a word of any length is merged
with a heap, so the time grows with n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, Table, gathered, kept, mix, slices, staged, text_bytes

#: Fixed values of the byte-level format: the pattern of words, and the bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a vocabulary entry stands for; the other bytes follow from U+0100 on."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(rest)}


NO_RANK = 1 << 40
#: White space beyond the six ASCII characters, in UTF-8.
OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_is_space = np.zeros(256, bool)
_is_space[list(SPACE_BYTES)] = True


class Vocabulary:
    """Ids, bytes and merge ranks of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = byte_of_char()
        raw = lambda s: bytes(table[c] for c in s)
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: raw(s) for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.byte_id[b[0]] = i
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])

        pairs = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self._slots = _table(np.array([k for k, _, _ in pairs], np.uint64))
        self._rank = np.array([r for _, r, _ in pairs] + [NO_RANK], np.int64)
        self._new = np.array([n for _, _, n in pairs] + [-1], np.int64)
        self._byte_id = np.array(self.byte_id, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """The exact token ids of one word."""
        ids = [self.byte_id[b] for b in word]
        return self._merge_long(ids) if len(ids) > 40 else self._merge_short(ids)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """The exact token ids of many words: in each round every word merges its pair of the lowest rank."""
        out: list[list[int]] = [[] for _ in words]
        short = [k for k, w in enumerate(words) if len(w) <= 40]
        for k, w in enumerate(words):
            if len(w) > 40:
                out[k] = self.merge(w)
        if not short:
            return out
        n = np.array([len(words[k]) for k in short])
        ids = self._byte_id[np.frombuffer(b"".join(words[k] for k in short), np.uint8)]
        word = np.repeat(np.arange(len(short)), n)
        while len(ids):
            at = _find(self._slots, (ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:].astype(np.uint64))
            rank = np.append(np.where(word[1:] == word[:-1], self._rank[at], NO_RANK), NO_RANK)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            low = np.minimum.reduceat(rank, first)
            done = low == NO_RANK
            if done.any():
                for k, a, c in zip(word[first[done]].tolist(), first[done].tolist(), size[done].tolist()):
                    out[short[k]] = ids[a : a + c].tolist()
                keep = np.repeat(~done, size)
                ids, word, rank, low = ids[keep], word[keep], rank[keep], low[~done]
                at, size = np.append(at, len(self._new) - 1)[keep], size[~done]
                if not len(ids):
                    break
            else:
                at = np.append(at, len(self._new) - 1)
            hit = rank == np.repeat(low, size)
            for i in np.flatnonzero(hit[1:] & hit[:-1]).tolist():  # in a run of one symbol every other pair merges
                if hit[i]:
                    hit[i + 1] = False
            ids = np.where(hit, self._new[at], ids)
            keep = np.append(True, ~hit[:-1])
            ids, word = ids[keep], word[keep]
        return out

    def _merge_short(self, ids: list[int]) -> list[int]:
        merges = self.merges
        while len(ids) > 1:
            found = [m for m in map(merges.get, zip(ids, ids[1:])) if m]
            if not found:
                break
            rank, new = min(found)
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and merges.get((ids[i], ids[i + 1])) == (rank, new):
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]


def _table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """An open hash table of sorted distinct keys: slots hold places in keys, or len(keys) for none."""
    bits = max(4, int(len(keys) * 4).bit_length())
    slots = np.full(1 << bits, len(keys), np.int64)
    home, todo = (mix(keys) & np.uint64((1 << bits) - 1)).astype(np.int64), np.arange(len(keys))
    while len(todo):
        free = todo[slots[home[todo]] == len(keys)]
        slots[home[free]] = free
        todo = todo[slots[home[todo]] != todo]
        home[todo] = (home[todo] + 1) & ((1 << bits) - 1)
    return slots, np.append(keys, np.uint64(2**64 - 1)), (1 << bits) - 1


def _find(table: tuple[np.ndarray, np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    """The place of each key, len(keys of the table) where it isn't there."""
    slots, known, mask = table
    home = (mix(keys) & np.uint64(mask)).astype(np.int64)
    at = slots[home]
    todo = np.flatnonzero((at < len(known) - 1) & (known[at] != keys))
    while len(todo):
        home[todo] = (home[todo] + 1) & mask
        at[todo] = slots[home[todo]]
        todo = todo[(at[todo] < len(known) - 1) & (known[at[todo]] != keys[todo])]
    return at


def coder(path: str, lexicon: bytes | None = None) -> Coder:
    """A worker's own coder, kept for its next tasks."""
    return kept(("bpe", path, hashlib.sha256(lexicon or b"").digest()), lambda: Coder(path, lexicon))


class Lexicon:
    """A minimal acyclic transducer over words (bytes), with the token ids of each word.

    An arc is (state * 256 + byte) in a sorted table, with its target and its output; a word's index is the sum of the
    outputs on its path plus nothing at a final state, so the words' ids lie in one array with offsets.
    """

    NAMES = ("keys", "targets", "outputs", "final", "starts", "ids")

    def __init__(self, blob: bytes | mmap.mmap):
        sizes = np.frombuffer(blob, np.int64, len(self.NAMES))
        at = 8 * len(self.NAMES)
        for name, n in zip(self.NAMES, sizes):
            setattr(self, name, np.frombuffer(blob, np.int64, int(n), at))
            at += 8 * int(n)

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> bytes:
        """The transducer of these words: sorted insertion, equal states merged as soon as their futures are known."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        arcs: list[tuple[tuple[int, int], ...]] = []  # of each state: (byte, target)
        ends: list[bool] = []
        counts: list[int] = []  # words from each state on

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(arcs)
                arcs.append(key[1])
                ends.append(key[0])
                counts.append(int(key[0]) + sum(counts[t] for _, t in key[1]))
            return register[key]

        path, last = [[False, []]], b""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            for k in range(len(last), same, -1):
                state = freeze(path.pop())
                path[-1][1].append((last[k - 1], state))
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        for k in range(len(last), 0, -1):
            state = freeze(path.pop())
            path[-1][1].append((last[k - 1], state))
        root = freeze(path[0])
        number = {root: 0} | {s: 0 for s in range(len(arcs))}
        for n, s in enumerate([root, *(s for s in range(len(arcs)) if s != root)]):
            number[s] = n
        table = []
        for s, out in enumerate(arcs):
            before = int(ends[s])
            for byte, target in out:
                table.append((number[s] * 256 + byte, number[target], before))
                before += counts[target]
        table.sort()
        final = [0] * len(arcs)
        for s, e in enumerate(ends):
            final[number[s]] = int(e)
        starts = [0, *np.cumsum([len(entries[w]) for w in words], dtype=np.int64)]
        parts = [*(zip(*table) if table else ((), (), ())), final, starts, [i for w in words for i in entries[w]]]
        arrays = [np.asarray(p, dtype=np.int64) for p in parts]
        return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def mapped(cls, blob: bytes) -> Lexicon:
        """The same lexicon from a file mapped into memory; the file has no name any more and goes with the process."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, -1 where it isn't in the lexicon; all words walk the automaton together."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(n) - n
        state, index = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live, depth = np.flatnonzero(n >= 0), 0
        if not len(self.keys):
            return np.full(len(words), -1)
        while len(live := live[n[live] > depth]):
            key = state[live] * 256 + raw[start[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            state[live[~found]] = -1
            live, at = live[found], at[found]
            state[live] = self.targets[at]
            index[live] += self.outputs[at]
            depth += 1
        known = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(known, index, -1)

    def tokens(self, index: int) -> list[int]:
        return self.ids[self.starts[index] : self.starts[index + 1]].tolist()


class Coder:
    """Encodes and decodes texts; remembers a bounded number of words."""

    def __init__(self, path: str, lexicon: bytes | None = None, remember: int = 400_000):
        self.vocabulary = Vocabulary(path)
        self.lexicon = Lexicon.mapped(lexicon) if lexicon else None
        self.words = regex.compile(PATTERN)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        size = max(self.vocabulary.bytes_of) + 1
        self.bytes_of = _laid_out([self.vocabulary.bytes_of.get(i, b"") for i in range(size)])
        self.digits_of = _laid_out([b"%d," % i for i in range(size)])
        self.known: dict[str, bytes] = {}
        self.remember = remember
        self.units = Table(remember, "<u4", self.learn)

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token's string stands for itself wherever it occurs."""
        if self.special is None or not self.special.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words.findall(text[at:])

    def learn(self, units: list[bytes]) -> list[bytes]:
        """The ids of stretches of text that are met for the first time, as bytes; their words are remembered as well."""
        if len(self.known) > self.remember:
            self.known.clear()
        split = [self.split(u.decode("utf-8", "replace")) for u in units]
        new = list({w for words in split for w in words if w not in self.known})
        raw = [w.encode() for w in new]
        at = self.lexicon.find(raw).tolist() if self.lexicon and raw else [-1] * len(raw)
        special = self.vocabulary.special
        unseen = iter(self.vocabulary.merge_many([b for w, b, i in zip(new, raw, at) if i < 0 and w not in special]))
        for w, i in zip(new, at):
            ids = [special[w]] if w in special else self.lexicon.tokens(i) if i >= 0 else next(unseen)
            self.known[w] = np.array(ids, "<u4").tobytes()
        known = self.known
        return [known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words]) for words in split]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of UTF-8 bytes laid end to end."""
        if OTHER_SPACE.search(raw.tobytes()):
            return [self._encode(raw[a:b], np.array([0, b - a]))[0] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        return self._encode(raw, offsets)

    def _encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Texts are cut before a space or line break between two other characters, where a word begins whatever stands around."""
        body = raw.tobytes()
        if OTHER_SPACE.search(body):
            return [np.frombuffer(self.learn([body])[0], "<u4")]
        letter = ~_is_space[raw]
        begins = np.zeros(len(raw), bool)
        if len(raw):
            begins[1:-1] = ((raw == 32) | (raw == 10))[1:-1] & letter[:-2] & letter[2:]
            begins[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(begins)
        ids, n = self.units.of_spans(raw, start, np.append(start[1:], len(raw))[: len(start)])
        return np.split(ids, np.append(0, np.cumsum(n))[np.searchsorted(start, offsets[1:-1])]) if len(offsets) > 1 else []

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return _of_each(self.bytes_of, ids).tobytes().decode("utf-8", "replace")

    def joined(self, ids: np.ndarray) -> bytes:
        """The decimal ids, joined by commas."""
        return _of_each(self.digits_of, ids).tobytes()[:-1]


def _laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def _of_each(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    values, start, size = table
    out = [gathered(values, start[part], size[part]) for k in range(0, len(ids), 1 << 18) if len(part := ids[k : k + (1 << 18)])]
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def frequent_words(docs: DataFrame, *, size: int = 100_000) -> list[str]:
    """The corpus's most frequent words, in the sense of PATTERN, counted over every text.

    Words are taken by levels of their counts, from the most frequent on, as long as whole levels fit into size; words
    that occur once are none. So the driver gets the words of the lexicon only.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = regex.compile(PATTERN)
        count: Counter[str] = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0):
                count.update(words.findall(text.as_py() or ""))
                if len(count) > 400_000:
                    yield give()
                    count.clear()
        if count:
            yield give()

    parts = docs.select("text").mapInArrow(counted, "word string, n long").filter(F.octet_length("word") <= 64)
    counts = staged(parts.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "words")
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()  # a few hundred rows
    total, least = 0, None
    for r in sizes:
        total += r.words
        if total > size:
            break
        least = r.level
    return [] if least is None else sorted(r.word for r in counts.filter(level >= least).select("word").collect())  # size at most


def compiled_lexicon(docs: DataFrame, path: str, *, size: int = 100_000) -> bytes:
    vocabulary = Vocabulary(path)
    return Lexicon.compile({w.encode(): vocabulary.merge(w.encode()) for w in frequent_words(docs, size=size)})


def encode(docs: DataFrame, path: str, *, lexicon_size: int = 100_000, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (array<int>), or with digests: ids_sha256 and decoded_sha256 after a round trip."""
    shared = docs.sparkSession.sparkContext.broadcast(compiled_lexicon(docs, path, size=lexicon_size))
    kind = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, shared.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches, "text", 1 << 20):
            found = own.encode(*text_bytes(batch.column("text")))
            n = pa.array([len(ids) for ids in found], pa.int64())
            if digests:
                rest = [pa.array([sha(own.joined(ids)) for ids in found], pa.string()), pa.array([sha(own.decode(ids).encode()) for ids in found], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *rest], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, ids], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows doc_id, ids (array<int>); null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            texts = pa.array([own.decode(np.array(r or [], np.int64)) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
