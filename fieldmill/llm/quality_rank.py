"""Quality classifier by Bradley-Terry ranking: scores from preferences, then a threshold at a quantile of the scores.

Every text is described by shares of character classes, lengths, and how much of it repeats. Pairs of a good and a
bad labelled text are preferences; weights are fitted by the logistic loss on the differences of their features. The
threshold is the quantile of the labelled scores at the share of bad texts among them. Fitting uses at most
sample_size labelled rows (those with the smallest hashes of their ids) and draws pairs preferences among them, each one
good and one bad text, with a fixed seed; scoring covers all texts.

Nulls count as empty texts, whose features are all zero. Labels that are null are left out; of several labels of one
document the least counts. Rows that share a doc_id each learn from its label, and a null doc_id has none. Without both
kinds of labels every score is one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, nothing_kept, slices, text_bytes
from .ngram_join import shingles

CHUNK = 1 << 20
#: Byte classes, in order: other, lower case, upper case, digit, sentence mark, symbol, other ASCII mark, space, line break, above ASCII.
N_CLASSES = 10
_class = np.zeros(256, np.uint8)
_class[97:123], _class[65:91], _class[48:58] = 1, 2, 3
for _code, _chars in ((6, b"\"'()-/@[\\]^_`{}~+="), (4, b".,;:!?"), (5, b"#*$%&|<>")):
    _class[list(_chars)] = _code
_class[list(SPACE_BYTES)] = 7
_class[10] = 8
_class[128:] = 9


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text: shares of classes and their roots, marks and lines per word, lengths, and shares of repeats."""
    kinds = _class[raw]
    counts = np.zeros((len(offsets) - 1, N_CLASSES))
    for k in range(1, N_CLASSES):
        total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        counts[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    size = np.maximum(1, np.diff(offsets))
    space = np.isin(kinds, (7, 8))
    begins = ~space & np.append(True, space[:-1])[: len(space)]
    begins[offsets[:-1][offsets[:-1] < len(raw)]] |= ~space[offsets[:-1][offsets[:-1] < len(raw)]]
    total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    n = total[offsets[1:]] - total[offsets[:-1]]
    one, three = ([len(s) for s in shingles(raw, offsets, w)] for w in (1, 3))
    few = np.maximum(1, n)
    shares = counts / size[:, None]
    columns = [
        shares, np.sqrt(shares), (counts[:, 4] / few)[:, None], (counts[:, 8] / few)[:, None], np.log1p(n)[:, None],
        np.minimum(n, 20)[:, None], ((size - counts[:, 7] - counts[:, 8]) / few / 10)[:, None], (np.array(one) / few)[:, None],
        (np.array(one) / few**0.8)[:, None], (np.array(three) / np.maximum(1, n - 2))[:, None],
    ]
    return np.where((n > 0)[:, None], np.concatenate(columns, axis=1), 0.0)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample_size: int) -> DataFrame:
    """doc_id, text and label of the labelled documents with the smallest hashes, sample_size at most."""
    one = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    one = one.join(docs.select("doc_id"), "doc_id", "left_semi")  # of the documents here
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_size)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # sample_size bounds it


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample_size: int = 20_000, pairs: int = 60_000, penalty: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights, feature scales and threshold from the labels given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            x = features(*text_bytes(batch.column("text")))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], ["doc_id", "label", "x"])

    rows = labelled(docs, labels, label, sample_size).mapInArrow(run, "doc_id long, label double, x array<double>").orderBy("doc_id").toArrow()
    y = rows.column("label").to_numpy()
    if len(set(y)) < 2:
        return {"w": np.zeros(1), "mean": np.zeros(1), "scale": np.ones(1), "threshold": np.zeros(1)}
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1e9
    z = (x - mean) / scale
    random = np.random.default_rng(0)
    good, bad = np.flatnonzero(y >= 0.5), np.flatnonzero(y < 0.5)
    d = z[random.choice(good, pairs)] - z[random.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton's method on the logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w)), d.T @ p / pairs - penalty * w)
        w += step * min(1.0, 2 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    threshold = np.quantile(z @ w, len(bad) / len(y))
    return {"w": w, "mean": mean, "scale": scale, "threshold": np.array([threshold])}


def score(docs: DataFrame, model: dict[str, np.ndarray], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named, score (one half at the threshold) and predicted."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    wanted = list(dict.fromkeys([*columns, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for batch in slices(batches, "text", CHUNK):
            z = (features(*text_bytes(batch.column("text"))) - model["mean"]) / model["scale"]
            s = 1 / (1 + np.exp(-np.clip(z @ (model["w"] if len(model["w"]) > 1 else np.zeros(z.shape[1])) - model["threshold"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*columns, "score", "predicted"])

    kind = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "score double, predicted int"])
    return docs.select(*wanted).mapInArrow(run, kind)
