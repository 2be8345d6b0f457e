"""Token counts at every prefix of a text, for a sentencepiece BPE model with byte fallback.

A text falls into chunks that no piece spans (spaces with the word they precede; line breaks). Inside a chunk a
dynamic program over prefixes finds, for each prefix, the one piece that ends it: the piece whose pair with the piece
before it would come out of BPE as that pair. The count at a prefix is then one more than at the place where that
piece starts. A text's count at any prefix is the sum over the chunks before and the chunk's own entry, so questions
about truncation and budgets need no further encoding.

Nulls count as empty, and an empty text has no tokens. Rows are counted each by itself, whatever their ids are. A chunk of any length takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, kept, slices, text_bytes

SPACE = "▁"  # stands for a space in the model's pieces


class PrefixCounter:
    """Counts tokens at prefixes; remembers a bounded number of chunks and pairs."""

    def __init__(self, path: str, remember: int = 600_000, remember_pairs: int = 1_600_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): (-model.get_score(i), i) for i in usual}
        self.rank = {p: k for k, p in enumerate(sorted(self.rank, key=self.rank.__getitem__))}
        self.longest = max(map(len, self.rank))
        inside = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        breaks = any("\n" in p for p in self.rank)
        if inside or breaks:  # then a piece may span chunks: the whole text is one
            self.chunks = re.compile(r"[\s\S]+")
        else:
            self.chunks = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.remember_pairs = remember_pairs
        self.total = Table(remember, "<i4", lambda chunks: [np.int32(self.table(c.decode("utf-8", "replace").replace(" ", SPACE))[-1]).tobytes() for c in chunks])
        self.whole = inside or breaks
        self.pairs: dict[tuple[str, str], bool] = {}

    def pieces(self, chunk: str) -> list[str]:
        """BPE as it is defined: again and again the adjacent pair whose union ranks first, the leftmost of equals."""
        parts, rank = list(chunk), self.rank
        while len(parts) > 1:
            found = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get(a + b)) is not None]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, before: str, piece: str) -> bool:
        """Whether piece can stand after before (or, if that is empty, at the start) in the output of BPE."""
        key = (before, piece)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.remember_pairs:
                self.pairs.clear()
            known = self.pairs[key] = self.pieces(before + piece) == ([before, piece] if before else [piece])
        return known

    def table(self, chunk: str) -> list[int]:
        """The token count at each prefix of a chunk, by characters from 0 to its length."""
        rank, pairs, follows = self.rank, self.pairs, self.follows
        counts, last = [0], [""]
        for end in range(1, len(chunk) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = chunk[start:end]
                if piece in rank or start == end - 1:
                    before = last[start]
                    fits = pairs.get((before, piece))
                    if fits or fits is None and follows(before, piece):
                        own = 1 if piece in rank else len(piece.encode())  # bytes stand for an unknown character
                        counts.append(counts[start] + own)
                        last.append(piece)
                        break
        return counts

    def split(self, text: str) -> list[str]:
        """The chunks of a text, after the model's own start: a space before any text, and spaces written as SPACE."""
        return self.chunks.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def counts(self, chunks: list[str]) -> list[int]:
        places = self.total.places([c.encode() for c in chunks])
        return self.total.values[self.total.start[places]].tolist()

    def count(self, text: str) -> int:
        return sum(self.counts(self.split(text)))

    def count_all(self, raw: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The token count of each text of UTF-8 bytes laid end to end, and the characters of its longest prefix of at most limit tokens."""
        texts = len(offsets) - 1
        some = np.diff(offsets) > 0
        raw = np.insert(raw, offsets[:-1][some], 32)  # the model's own start
        offsets = offsets + np.append(0, np.cumsum(some))
        body, n, fit = raw.tobytes(), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        if self.whole or SPACE.encode() in body:  # which is in no usual text
            for k, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                text = body[a + 1 : b].decode("utf-8", "replace")
                n[k], fit[k] = self.count(text), self.fit(text, limit)
            return n, fit
        before = np.append(10, raw[:-1])[: len(raw)]
        begins = (raw == 10) | (before == 10) | ((raw == 32) & (before != 32))
        begins[offsets[:-1][some]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(raw))[: len(start)]
        ends = np.append(0, np.cumsum(self.total.of_spans(raw, start, end)[0], dtype=np.int64))
        chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        place = np.searchsorted(start, offsets)
        n = np.diff(ends[place])
        fit = np.maximum(0, np.diff(chars[offsets]) - 1)
        for k in np.flatnonzero(n > limit).tolist():
            base = int(ends[place[k]])
            cut = int(np.searchsorted(ends, base + limit, side="right")) - 1  # the chunk that doesn't fit as a whole
            chunk = body[start[cut] : end[cut]].decode("utf-8", "replace").replace(" ", SPACE)
            inner = max((j for j, m in enumerate(self.table(chunk)) if ends[cut] + m <= base + limit), default=0)
            fit[k] = max(0, int(chars[start[cut]] - chars[offsets[k]]) + inner - 1)
        return n, fit

    def at_every_prefix(self, text: str) -> np.ndarray:
        """The exact token count of text[:k] for each k from 0 to its length (the empty prefix has none)."""
        out, base = [], 0
        for chunk in self.split(text):
            table = self.table(chunk)
            out += [base + n for n in table[1:]]
            base += table[-1]
        return np.array([0, *out[1:]], np.int64) if text else np.zeros(1, np.int64)  # out[0] ends after the added space

    def fit(self, text: str, limit: int) -> int:
        """The characters of the longest prefix of at most limit tokens."""
        chunks = self.split(text)
        ends = np.cumsum(self.counts(chunks), dtype=np.int64)
        whole = int(np.searchsorted(ends, limit, side="right"))
        if whole == len(chunks):
            return len(text)
        base = int(ends[whole - 1]) if whole else 0
        inner = max((k for k, n in enumerate(self.table(chunks[whole])) if base + n <= limit), default=0)
        return max(0, sum(map(len, chunks[:whole])) + inner - 1)


def counter(path: str) -> PrefixCounter:
    """A worker's own counter, kept for its next tasks."""
    return kept(("token counts", path), lambda: PrefixCounter(path))


def count_tokens(docs: DataFrame, path: str, *, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars, the length of the longest prefix within the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches, "text", 1 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            n, fit = own.count_all(raw, offsets, limit)
            arrays = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit), pa.array(fit)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
