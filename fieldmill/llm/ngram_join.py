"""Similarity join on sets of word n-grams, and the groups that its links form.

Documents with equal sets are one class, and only one of each class is joined. A set's n-grams are ordered rare first;
the counts come from a table of fixed size that all n-grams are hashed into, and from the commonest n-grams of each task,
of which a bounded number is kept, so the order costs no shuffle of n-grams. Two sets of the asked likeness share an n-gram among the first few of each (prefix filter), have sizes that
are near (length filter), and stand early enough in each other's order (positional filter). What is left of a pair's
suffixes is compared by how many of their n-grams fall into each of 256 parts, which bounds their difference from
below (suffix filter). Pairs that pass are verified once, on their texts; there as in the filters an n-gram is known by
64 bits of hash.

Large groups of near copies are not expanded into all their pairs. A first round tries for each shared n-gram a chain of
its documents and forms components from the links found; the second tries every pair that passes all the filters and
whose components still differ, where the suffix filter, too, comes before a pair is written. So no link between two
components is missed, and a group costs about as much as its size. An n-gram with very many documents is split: its chain over
tasks, and the pairs across components into blocks, of which each two are a task of their own.

Words are runs of bytes other than ASCII white space, with A-Z in lower case. Nulls and texts without words have empty
sets and link with nothing. A text with fewer words than an n-gram has its whole word sequence as its only one. Rows of
equal or null doc_id are nodes of their own; see keyed().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, mix, nothing_kept, prefix_hashes, slices, span_hashes, staged, text_bytes, word_spans

BUCKETS = 1 << 15  # of the frequency table
PARTS = 256  # of the suffix filter
BLOOM_BITS = 1 << 23  # of the filter on documents to verify, whatever their number
CHUNK = 1 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams."""
    raw = _lower[raw]
    start, end = word_spans(raw, offsets)
    h = mix(span_hashes(prefix_hashes(raw), start, end)) if len(raw) else np.zeros(0, np.uint64)
    factor = np.uint64(0x9FB21C651E98DF25)
    at = np.searchsorted(start, offsets)
    grams = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        grams = grams * factor + h[k : k + len(grams)]
    grams = mix(grams + np.uint64(width))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for x in h[a:b]:
                one = one * factor + x
            out.append(mix(one + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n, percent: int):
    """The least size of an intersection for a set of n and another of the likeness asked."""
    return -(-percent * n // 100)


class Common:
    """The commonest of the n-grams that pass by, in bounded memory: when there are too many, the rarest so far are let go."""

    def __init__(self, most: int):
        self.most, self.waiting, self.size = most, [], 0
        self.grams, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, grams: np.ndarray) -> None:
        self.waiting.append(grams)
        self.size += len(grams)
        if self.size > 2 * self.most:
            self.count()

    def count(self) -> None:
        grams, place = np.unique(np.concatenate([self.grams, *self.waiting]), return_inverse=True)
        counts = np.bincount(place[len(self.counts) :], minlength=len(grams))
        counts[place[: len(self.counts)]] += self.counts
        if len(grams) > self.most:
            keep = np.sort(np.argpartition(counts, -self.most)[-self.most :])
            grams, counts = grams[keep], counts[keep]
        self.grams, self.counts, self.waiting, self.size = grams, counts, [], 0

    def top(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At most n n-grams seen twice or more, and their counts since they were last let go."""
        self.count()
        order = np.lexsort((self.grams, -self.counts))[:n]
        order = order[self.counts[order] > 1]
        return self.grams[order], self.counts[order]


def frequencies(docs: DataFrame, width: int, *, most: int = 100_000, most_each: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often n-grams occur: counts by bucket of their hashes, and the commonest n-grams (sorted) with counts of their own.

    Buckets tell less the more n-grams there are, but what very many texts share is known by itself at any size: each task
    names its most_each commonest, and the most commonest of all tasks together are kept. Only the order within sets
    depends on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        total, common = np.zeros(BUCKETS, np.int64), Common(1 << 18)
        for batch in slices(batches, "text", CHUNK):
            grams = np.concatenate(shingles(*text_bytes(batch.column("text")), width))
            total += np.bincount((grams & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            common.add(grams)
        at = np.flatnonzero(total)
        grams, counts = common.top(most_each)
        own = np.append(np.zeros(len(at), bool), np.ones(len(grams), bool))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.append(at, grams.view(np.int64))), pa.array(np.append(total[at], counts))], ["own", "at", "n"])

    sums = docs.select("text").mapInArrow(run, "own boolean, at long, n long").groupBy("own", "at").agg(F.sum("n").alias("n"))
    rows = sums.orderBy("own", F.desc("n"), "at").limit(BUCKETS + most).toArrow()  # the buckets come first
    own, at, n = (rows.column(c).to_numpy() for c in ("own", "at", "n"))
    table = np.zeros(BUCKETS, np.int64)
    table[at[~own]] = n[~own]
    grams = at[own].view(np.uint64)
    order = np.argsort(grams)
    return table, grams[order], n[own][order]


def how_common(grams: np.ndarray, table: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for each n-gram that grows with its occurrences; those with counts of their own come after all others."""
    out = table[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)]
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        out = np.where(known[at] == grams, counts[at] + (1 << 48), out)
    return out


def described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """key, n (set size), digest (of the set), parts (counts of the suffix filter), prefix (the rarest n-grams, in order)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, width))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        known = shared.value
        for batch in slices(batches, "text", CHUNK):
            sets = shingles(*text_bytes(batch.column("text")), width)
            digests, parts, prefixes = [], [], []
            for s in sets:
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                parts.append(np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes())
                order = np.lexsort((s, how_common(s, *known)))
                prefixes.append(s[order[: len(s) - needed(len(s), percent) + 1]].view(np.int64) if len(s) else np.zeros(0, np.int64))
            n = np.array([len(s) for s in sets], np.int64)
            ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
            arrays = [batch.column("key"), pa.array(n), pa.array(digests, pa.binary()), pa.array(parts, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n", "digest", "parts", "prefix"])

    return docs.select("key", "text").mapInArrow(run, "key long, n long, digest binary, parts binary, prefix array<long>")


def classes(sets: DataFrame, salts: int = 16) -> DataFrame:
    """key and rep, the smallest key with an equal set, for sets with members."""
    some = sets.filter("n > 0").select("key", "digest")
    several = some.groupBy("digest").agg(F.min("key").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    wide = several.select("digest", "rep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = some.withColumn("salt", F.pmod(F.hash("key"), F.lit(salts)))
    return salted.join(wide, ["digest", "salt"], "left").select("key", F.coalesce("rep", "key").alias("rep"))


def shared_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """token, key, n, pos of prefix entries whose n-gram another set's prefix has too; before, the document before it in the n-gram's chain.

    before is -1 where there is none of near size. Every n-gram has a chain order of its own, so a group's documents get
    many different neighbours. Entries are dealt by ranges of (token, place in the chain), so a common n-gram's are in
    several tasks. The first and last entry of a task count as shared, as the other may be in the next task.
    """
    entries = sets.select("key", "n", F.posexplode("prefix").alias("pos", "token"))
    placed = entries.select("token", F.xxhash64("key", "token").alias("chain"), "key", "n", "pos")
    ordered = placed.repartitionByRange("token", "chain", "key").sortWithinPartitions("token", "chain", "key").drop("chain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        held, tied, before_held = None, True, -1  # the last entry, and whether it is shared with the one before or the task's first
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("token", "key", "n", "pos")]
            cols = cols if held is None else [np.append(h, c) for h, c in zip(held, cols)]
            token, key, n, _ = cols
            same = np.append(False, token[1:] == token[:-1])
            last_n = np.append(0, n[:-1])
            near = same & (100 * np.minimum(n, last_n) >= percent * np.maximum(n, last_n))
            before = np.where(near, np.append(-1, key[:-1]), -1)
            before[0] = before_held
            shared = same | np.append(same[1:], False)
            shared[0] |= tied
            yield given([c[:-1] for c in cols], before[:-1], shared[:-1])
            held, tied, before_held = [c[-1:] for c in cols], bool(same[-1]) or len(same) == 1 and tied, before[-1]
        if held is not None:
            yield given(held, np.array([before_held]), np.array([True]))

    def given(cols: list[np.ndarray], before: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[shared]) for c in (*cols, before)], ["token", "key", "n", "pos", "before"])

    return ordered.mapInArrow(run, "token long, key long, n long, pos int, before long")


def across(entries: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """a, b: pairs with a common n-gram in their prefixes that pass all filters and whose components (comp) differ.

    An n-gram with more than most entries is cut into blocks, and each two blocks meet in a task of their own.
    """
    per = entries.groupBy("token").agg(F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    blocks = per.filter("lo < hi").select("token", F.ceil(F.col("rows") / most).cast("int").alias("blocks"))
    placed = entries.join(blocks, "token").withColumn("block", F.pmod(F.hash("key"), F.col("blocks"))).join(sets.select("key", "parts"), "key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", other).select(
        "token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "pos", "comp", "parts"
    )
    ordered = placed.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "comp", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            whole = last_group(held)
            if whole:
                yield from pairs(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from pairs(held)

    def group_edges(table: pa.Table) -> np.ndarray:
        token, i, j = (table.column(c).to_numpy() for c in ("token", "i", "j"))
        return np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))

    def last_group(table: pa.Table) -> int:
        return int(group_edges(table)[-1]) if table.num_rows else 0

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j, block, key, n, pos, comp = (table.column(c).to_numpy() for c in ("i", "j", "block", "key", "n", "pos", "comp"))
        parts = text_bytes(table.column("parts"))[0].reshape(-1, PARTS)
        edges = np.append(group_edges(table), table.num_rows)
        found, size = [], 0
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if comp[a] == comp[b - 1]:
                continue
            firsts = np.append(np.flatnonzero(np.append(True, comp[a + 1 : b] != comp[a : b - 1])) + a, b)
            sizes = np.diff(firsts)
            large = int(np.argmax(sizes))
            rest = np.concatenate([np.arange(a, firsts[large]), np.arange(firsts[large + 1], b)])
            step = max(1, 500_000 // (b - a))
            for at in range(0, len(rest), step):
                x = rest[at : at + step][:, None]
                y = np.arange(a, b)[None, :]
                ok = comp[x] != comp[y]
                ok &= (y < x) | ((y >= firsts[large]) & (y < firsts[large + 1]))  # each pair once
                if i[a] != j[a]:
                    ok &= block[x] != block[y]
                nx, ny = n[x], n[y]
                ok &= 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
                least = -(-percent * (nx + ny) // (100 + percent))
                ok &= 1 + np.minimum(nx - pos[x] - 1, ny - pos[y] - 1) >= least
                p, q = np.nonzero(ok)
                p, q = x[p, 0], y[0, q]
                for k in range(0, len(p), 20_000):
                    u, v = p[k : k + 20_000], q[k : k + 20_000]
                    like = alike(parts[u], parts[v], n[u] + n[v], percent)
                    found.append(np.stack([key[u[like]], key[v[like]]]))
                    size += int(like.sum())
            if size > 200_000:
                yield distinct(found)
                found, size = [], 0
        if found:
            yield distinct(found)

    def distinct(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found, axis=1)
        both = np.unique(np.sort(both, axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def alike(one: np.ndarray, two: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of together n members may be as like as asked, by the counts of their parts."""
    apart = np.abs(one.astype(np.int16) - two).sum(axis=1)
    return apart <= n - 2 * -(-percent * n // (100 + percent))


def filtered(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs whose sets may be as like as asked, by the counts of their parts."""
    side = sets.select("key", "n", "parts")
    one = side.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa"))
    two = side.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (text_bytes(batch.column(c))[0].reshape(-1, PARTS) for c in ("pa", "pb"))
                keep = alike(one, two, batch.column("na").to_numpy() + batch.column("nb").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.distinct().join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose texts' sets are as like as asked. Only documents in a pair are sent, picked by a filter of fixed size."""
    import zstandard

    pairs = staged(pairs, "pairs")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BLOOM_BITS)).cast("int")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("key")).select(place("key").alias("p"))
    words = ids.groupBy((F.col("p") / 32).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, p % 32))").alias("bits")).collect()
    table = np.zeros(BLOOM_BITS // 32, np.int64)
    for r in words:
        table[r.w] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        press, bits = zstandard.ZstdCompressor(level=3), shared.value
        for batch in batches:
            p = batch.column("p").to_numpy()
            batch = batch.filter(pa.array((bits[p // 32] >> (p % 32)) & 1 == 1))
            z = pa.array([press.compress((t.as_py() or "").encode()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), z], ["key", "z"])

    texts = staged(docs.select("key", place("key").alias("p"), "text").mapInArrow(pick, "key long, z binary"), "texts")
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("key").alias("b"), F.col("z").alias("zb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        undo = zstandard.ZstdDecompressor()
        for batch in slices(batches, "za", CHUNK // 4):
            raw = [undo.decompress(z.as_py()) for c in ("za", "zb") for z in batch.column(c)]
            offsets = np.cumsum([0, *map(len, raw)], dtype=np.int64)
            sets = shingles(np.frombuffer(b"".join(raw), np.uint8), offsets, width)
            keep = []
            for x, y in zip(sets[: batch.num_rows], sets[batch.num_rows :]):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return staged(both.mapInArrow(check, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node with a link.

    In each round every node hangs on its smallest neighbour, trees are flattened, and each becomes a node; a round at
    least halves what is left. Rounds are written tables.
    """
    edges = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct(), "edges")
    root = staged(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("root")), "roots")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up"))
        up = staged(up, "up")
        while True:  # flatten: each jump halves the depth
            higher = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = staged(up.join(higher, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            up = jumped.select("node", "up")
            if jumped.filter("moved").isEmpty():
                break
        root = staged(root.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        moved = edges.join(up.select(F.col("node").alias("u"), F.col("up").alias("x")), "u").join(up.select(F.col("node").alias("v"), F.col("up").alias("y")), "v")
        edges = staged(moved.filter("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
    return root


def relabelled(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links between the components known, each named by its root."""
    one, two = (known.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    return links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))


def merged(known: DataFrame, more: DataFrame) -> DataFrame:
    """node and root of components known before, joined by more, whose nodes are their roots or alone until now."""
    top = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = known.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return old.unionByName(more.join(known, "node", "left_anti"))


def groups(docs: DataFrame, *, width: int = 4, percent: int = 85, most: int = 10_000) -> DataFrame:
    """key, n_shingles and component (the smallest key of its group) of docs with key and text."""
    sets = staged(described(docs, width, percent), "sets")
    rep = staged(classes(sets), "classes")
    one_each = sets.join(rep.filter("key = rep").select("key"), "key", "left_semi")
    entries = staged(shared_prefixes(one_each, percent), "entries")
    chained = entries.filter("before >= 0").select(F.least("key", "before").alias("a"), F.greatest("key", "before").alias("b"))
    known = components(verified(filtered(chained, sets, percent), docs, width, percent))
    roots = known.withColumnRenamed("node", "key")
    labelled = entries.drop("before").join(roots, "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
    between = verified(across(labelled, sets, percent, most), docs, width, percent)
    known = merged(known, components(relabelled(between, known)))
    root = rep.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("component"))
    return sets.select("key", F.col("n").alias("n_shingles")).join(root, "key", "left").select("key", "n_shingles", F.coalesce("component", "key").alias("component"))


def join(docs: DataFrame, *, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id of its group) for every row; key tells rows of equal doc_id apart."""
    rows = keyed(docs)
    found = groups(rows.select("key", "text"), width=width, percent=percent)
    names = rows.select(F.col("key"), F.col("doc_id"))
    with_id = found.join(names, "key")
    first = names.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id"))
    return with_id.join(first, "component").select("doc_id", "n_shingles", "component_id", "key")
