"""Toxicity of texts, scored after restoring disguised words.

A noisy channel turns letters into look-alikes, repeats them, or puts spaces and marks between them. A token that
may have gone through it, or a run of single characters, becomes a lattice of the letters it could stand for, in which
a word may also end at each space or mark, and Viterbi's algorithm finds the likeliest words under a character trigram
model. The model's counts are taken from every text of the corpus, into a table
of fixed size. The restored words' weights come from a logistic regression on words and word beginnings that are
commoner in toxic texts, fitted on at most sample_size labelled documents here of each kind (those with the smallest
hashes). Most toxic texts hold several such words, so the regression asks little of each alone. Hence words that speak
for themselves: a score is no less than the lower end of the interval of the share of toxic texts among those that hold a
word, where that end is at least sure. Near copies in the sample count once for that, so what only one text's copies have in
common proves nothing.

Nulls count as empty texts; an empty text has the score of the bias alone. Labels that are null are left out; of
several labels of one document the least counts. Rows that share a doc_id each learn from its label, and a null doc_id has
none. Without both kinds of labels every score is near 1 or near 0, by the kind there is.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, mix, nothing_kept, slices, staged

#: The alphabet of the character model: 0 is a word's edge, 1 any other character.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëçàâîïôûùœñáíóúìòãõåøæ"
A = len(LETTERS) + 2
#: What look-alikes may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
BETWEEN = ".-_*'~ "
EDGE = "\"'`.,;:!?()[]{}<>#*$%&|/\\~^_+=-…«»„“”‚‘’"

_code = {c: k + 2 for k, c in enumerate(LETTERS)}
_codes = np.ones(0x2100, np.int64)
for _c, _k in _code.items():
    _codes[ord(_c)] = _k
for _c in " \t\n\r\x0b\x0c":
    _codes[ord(_c)] = 0
#: What it costs that a look-alike before or after a token's letters is only a mark, less than nothing where that is
#: the rule; 6 each where it isn't named, but 4 for three or more alike.
LEADS = {"(": -3.0, "*": 0.0, "@": 1.5, "+": 3.0, "|": 3.0, "$": 4.0, "!": 4.0, "€": 4.0}
TRAILS = {"!": -3.0, "*": 0.0}
#: Marks around a token that stand for no letter.
MARKS = "".join(c for c in EDGE if c not in LOOKS)

_inside = re.compile(rf"[^\W\d_][0-9@$!|+(€*{re.escape(MARKS)}]+[^\W\d_]|(.)\1\1|^[0-9@$!|+(€*]+[^\W\d_]|[^\W\d_][0-9@$!|+(€*]+$")
_gap = rf"[\s*{re.escape(MARKS)}]"
_one = r"[^\W_]|[@$!|+(€]"
_spaced = re.compile(rf"(?<!\S)[{re.escape(EDGE)}]*?((?:{_one})(?:{_gap}++(?:{_one})){{2,}})(?=[{re.escape(EDGE)}]*+(?!\S))")
_gaps = re.compile(f"{_gap}+")
_letter = re.compile(r"[^\W\d_]")


def trigram_costs(docs: DataFrame) -> np.ndarray:
    """-log p(c | a, b) of the character model, shape (A, A, A), from the counts of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        total = np.zeros(A**3, np.int64)
        for batch in slices(batches, "text", 1 << 20):
            text = "\n\n".join(["", *(t.as_py() or "" for t in batch.column("text")), ""]).lower()
            c = _codes[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x20FF)]
            total += np.bincount((c[:-2] * A + c[1:-1]) * A + c[2:], minlength=A**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    n = np.zeros(A**3)
    for r in docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        n[r["at"]] = r["n"]  # A**3 rows at most
    three = n.reshape(A, A, A)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + A)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


class Restorer:
    """Finds the words that tokens stand for.

    Beside the character model a word of the lexicon may be meant, each at the same cost.
    """

    WORD_COST = 8.0
    END_COST = 1.0
    INNER_COST = 7.0

    def __init__(self, costs: np.ndarray, lexicon: list[str] | None = None):
        self.costs = costs
        self.lexicon = set(lexicon or ())
        self.starts = {w[:k] for w in self.lexicon for k in range(len(w) + 1)}

    def restore(self, token: str) -> str:
        """The likeliest words of a token that looks disguised or is spaced out, else the token without the marks around it."""
        if _spaced.fullmatch(token) and _letter.search(token):
            return self.decode(token)
        core = token.strip(MARKS)
        return self.decode(core) if _letter.search(core) and _inside.search(core) else token.strip(EDGE)

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each stretch of the token what it may stand for, with the channel's cost; a space is a word's end."""
        letters = [m.start() for m in re.finditer(r"[^\W_]", token)] or [0]
        first, last = letters[0], letters[-1]
        out = []
        for m in re.finditer(r"(.)\1*", token, re.S):
            c, n = m[1], len(m[0])
            options = [(c * min(n, 2), 0.0 if n < 3 else 1.0)] if c in _code else [(c, 4.0)]
            if c in _code and n > 1:
                options.append((c, 1.0 if n > 2 else 3.0))
            marks = c in LOOKS and not c.isdigit()
            outside = marks and not first <= m.start() <= last
            if outside:
                options = []
            options += [(x * k, 1.0 if k == n or n > 2 and k == 1 else 1.5 if k > 1 else 4.5) for x in LOOKS.get(c, "") for k in {1, min(n, 2)}]
            if c in BETWEEN and not outside:
                options += [("", 0.7), (" ", self.END_COST)]
            elif c in MARKS:
                options.append((" ", self.END_COST))
            elif outside:
                options.append((" ", (LEADS if m.start() < first else TRAILS).get(c, 6.0 * n if n < 3 else 4.0)))
            elif marks:
                options.append((" ", self.INNER_COST))
            out.append(options)
        return out

    def spaced_lattice(self, run: str) -> list[list[tuple[str, float]]]:
        """The lattice of characters that stand one by one: words go on over the run's narrowest gaps rather than over wider ones."""
        gaps = _gaps.findall(run)
        narrow = min(map(len, gaps))
        out = []
        for k, c in enumerate(_gaps.split(run)):
            if k:
                gap = gaps[k - 1]
                wide = len(gap) > narrow and "*" not in gap
                looks = [(x, 1.0) for x in LOOKS["*"]] if "*" in gap else []
                out.append([("", 2.0 if wide else 0.7), (" ", 0.0 if wide else self.END_COST), *looks])
            out += [[x for x in options if x[0] != " "] for options in self.lattice(c)]
        return out

    def decode(self, token: str) -> str:
        """The likeliest words of a token or of a run of single characters, with spaces between them."""
        return self.likeliest(self.spaced_lattice(token) if _spaced.fullmatch(token) else self.lattice(token))

    def likeliest(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The words of the cheapest path: each either by the character model or from the lexicon.

        A state is the last two letters, or what a lexicon's word begins with; paths are chains, so that time and
        memory are in proportion to the lattice.
        """
        costs = self.costs
        states: dict = {(0, 0): (0.0, None), "": (self.WORD_COST, None)}

        def ended(key, cost: float) -> float | None:
            if isinstance(key, str):
                return cost if key in self.lexicon else None
            return cost + float(costs[key[0], key[1], 0]) if key != (0, 0) else cost

        for options in lattice:
            after: dict = {}
            end = None
            for key, (cost, path) in states.items():
                for text, own in options:
                    if text == " ":
                        total = ended(key, cost + own)
                        if total is not None and (end is None or total < end[0]):
                            end = (total, (path, " "))
                        continue
                    total, state = cost + own, key
                    if isinstance(key, str):
                        if (state := key + text) not in self.starts:
                            continue
                    else:
                        for c in text:
                            k = _code.get(c, 1)
                            total += float(costs[state[0], state[1], k])
                            state = (state[1], k)
                    if state not in after or total < after[state][0]:
                        after[state] = (total, (path, text) if text else path)
            if end:
                for state, own in (((0, 0), 0.0), ("", self.WORD_COST)):
                    if state not in after or end[0] + own < after[state][0]:
                        after[state] = (end[0] + own, end[1])
            states = after
        done = [(total, path) for key, (cost, path) in states.items() if (total := ended(key, cost)) is not None]
        path, parts = min(done, key=lambda x: x[0])[1], []
        while path:
            path, text = path
            parts.append(text)
        return " ".join("".join(reversed(parts)).split())

    def features(self, token: str) -> list[str]:
        return [f for word in self.restore(token).split(" ") if len(word) > 2 for f in (word, *(f"{word[:k]}~" for k in (4, 5) if len(word) > k))]


def tokens(text: str) -> set[str]:
    """The distinct tokens of a text in lower case; characters that stand one by one count as a token too, with their gaps and without."""
    text = text.lower()
    found = set(text.split())
    for m in _spaced.finditer(text):
        found.add(m[1])
        found.add(_gaps.sub("", m[1]))
    return found


def sketch(found: list[str], bands: int = 10, width: int = 4) -> list[int]:
    """bands numbers, each from width min-hashes of the features; texts of likeness 0.8 share one with probability 0.995, of 0.1 with 0.001."""
    if not found:
        return []
    h = np.array([zlib.crc32(f.encode()) for f in found], np.uint64)
    salts = np.arange(1, bands * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    least = np.array([mix((h + np.uint64(1)) * (salt | np.uint64(1))).min() for salt in salts])
    out = np.zeros(bands, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + least[k::width])
    return (out + np.arange(bands, dtype=np.uint64)).view(np.int64).tolist()


def copies(sketches: list[list[int]]) -> list[int]:
    """For each sketch the place of the first one of its group: those that share a number, also by way of others."""
    top, seen = list(range(len(sketches))), {}

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for k, numbers in enumerate(sketches):
        for x in numbers:
            a, b = root(k), root(seen.setdefault(x, k))
            top[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(sketches))]


def least_share(yes: float, no: float, z: float = 1.96) -> float:
    """The lower end of Wilson's interval of a share."""
    n = yes + no
    p = yes / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def telling_alone(rows: DataFrame, each_no: float, sure: float) -> dict[str, float]:
    """Words and the least share of toxic texts among those of the sample that hold them, from sure on.

    Near copies are one text; a word without other texts counts as in half of one. Texts of label 0 count each_no times.
    Only sketches of the sample's rows are sent to the driver.
    """
    spark = rows.sparkSession
    sketches = rows.select("row", "sketch").orderBy("row").toArrow()  # of the sample
    first = copies(sketches.column("sketch").to_pylist())
    ids = sketches.column("row").to_pylist()
    groups = spark.createDataFrame(list(zip(ids, first)), "row long, first int")
    words = rows.select("row", "label", F.explode("found").alias("feature")).filter(~F.col("feature").endswith("~"))
    per = words.join(F.broadcast(groups), "row").groupBy("feature", "label").agg(F.count_distinct("first").alias("n"))
    per = per.groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("yes"), F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("no"))
    possible = per.filter(F.col("yes") >= sure * (F.col("yes") + F.coalesce("no", F.lit(0)) * each_no)).filter("yes >= 10")
    found = {r.feature: least_share(r.yes, ((r.no or 0) + 0.5) * each_no) for r in possible.collect()}  # a sample's words
    return {f: p for f, p in found.items() if p >= sure}


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample_size: int = 4000, n_features: int = 8192, sure: float = 0.9) -> dict:
    """The character model, the weights of words and beginnings, the bias, and the words that speak for themselves (alone)."""
    spark = docs.sparkSession
    costs = trigram_costs(docs)
    shared = spark.sparkContext.broadcast(costs)  # A**3 numbers
    one = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    one = staged(one.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxic-labels")  # of the documents here
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    n = {r.label: r.n for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {"costs": costs, "weights": {}, "bias": 5.0 if n.get(1) else -5.0, "alone": {}}
    sample = one.filter("label = 1").orderBy(*order).limit(sample_size).unionByName(one.filter("label = 0").orderBy(*order).limit(sample_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, memory = Restorer(shared.value), Memory(200_000)
        for batch in slices(batches, "text", 1 << 20):
            found = []
            for t in batch.column("text").to_pylist():
                own = tokens(t or "")
                for k in memory.missing(own):
                    memory[k] = restorer.features(k)
                found.append(sorted({f for k in own for f in memory[k]}))
            sketches = pa.array(map(sketch, found), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.string())), sketches], ["doc_id", "label", "found", "sketch"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(run, "doc_id long, label int, found array<string>, sketch array<bigint>")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "toxic-sample")
    each = rows.select("label", F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("label").alias("yes"), F.count("*").alias("n"))
    taken = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ratio = (F.col("yes") + 0.5) / taken[1] / ((F.col("n") - F.col("yes") + 0.5) / taken[0])
    telling = each.filter("yes >= 2").withColumn("gain", F.col("yes") * F.log(ratio)).filter("gain > 0").orderBy(F.desc("gain"), "feature").limit(n_features)
    names = [r.feature for r in telling.select("feature").collect()]
    places = spark.createDataFrame(list(zip(names, range(len(names)))), "feature string, place int")  # n_features at most
    known = rows.select("doc_id", "label", F.explode("found").alias("feature")).join(F.broadcast(places), "feature")
    cells = known.groupBy("doc_id", "label").agg(F.sort_array(F.collect_list("place")).alias("places")).toArrow()  # of sample_size rows
    lists = cells.column("places").combine_chunks()
    y = np.concatenate([cells.column("label").to_numpy(), np.zeros(taken[0] + taken[1] - len(cells))])  # the last: texts without any telling feature; the bias speaks for them
    at, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    prior = np.where(y == 1, n[1] / taken[1], n[0] / taken[0])  # the sample's kinds count as they do among all labels of documents here
    w, bias = logistic(row, at, y, prior / prior.mean(), len(names))
    each_no = (n[0] / taken[0]) / (n[1] / taken[1])
    return {"costs": costs, "weights": {f: float(v) for f, v in zip(names, w) if v > 0}, "bias": float(bias), "alone": telling_alone(rows, each_no, sure)}


def logistic(row: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, *, penalty: float = 0.02, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights of n features, none below 0, and bias of a logistic regression; example row[k] has feature at[k]."""
    w, bias = np.zeros(n), 0.0
    speed, speed_b = np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, w[at], minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(at, error[row], minlength=n) + penalty * w
        g_b = error.sum()
        speed, speed_b = speed + g * g, speed_b + g_b * g_b
        w = np.maximum(0.0, w - 0.5 * g / np.sqrt(speed))
        bias -= 0.5 * g_b / np.sqrt(speed_b)
    return w, float(bias)


def score(docs: DataFrame, model: dict, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named, score and predicted (1 from one half on)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted = list(dict.fromkeys([*columns, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        own = shared.value
        weights, alone, memory = own["weights"], own["alone"], Memory(250_000)
        restorer = Restorer(own["costs"], [w for w, v in weights.items() if v >= 0.5 and "~" not in w])
        for batch in slices(batches, "text", 1 << 20):
            z, least = [], []
            for t in batch.column("text").to_pylist():
                found = tokens(t or "")
                for k in memory.missing(found):
                    memory[k] = tuple(f for f in restorer.features(k) if f in weights or f in alone)
                telling = {f for k in found for f in memory[k]}  # each once, as in fit
                z.append(sum(weights.get(f, 0.0) for f in sorted(telling)))
                least.append(max((alone.get(f, 0.0) for f in telling), default=0.0))
            s = np.maximum(1 / (1 + np.exp(-np.clip(np.array(z) + own["bias"], -30, 30))), np.array(least))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*columns, "score", "predicted"])

    kind = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "score double, predicted int"])
    return docs.select(*wanted).mapInArrow(run, kind)
