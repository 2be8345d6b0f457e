"""A Merkle manifest of a dataset: a tree of digests for each language, one over their roots, and a proof for every row.

The log. Leaves are ranked within their tree by exact ranks of ranges. Every ARITY ** height consecutive leaves go
to one builder, which writes the nodes of its subtree in the order in which they are completed, children before parents
(postorder). The builders' top nodes are the leaves of the next round, until one builder sees all of a tree; the trees'
roots are the leaves of a last one. A round's log is appended in whole subtrees of one size, so a node's place in it
follows from its level and index alone: position() adds up the sizes of the subtrees before it.

Proofs. Rounds are read from the last to the first. A builder's part of the log is one run of digests; the siblings of
a node are found in it by their positions, and what lies above the part is handed down from the round before: to every
top node its own path. No node is looked up by all rows, and a task holds one part at a time.

Nulls: a null field is hashed as '-'; a null lang is a tree of its own, before all others; a null doc_id comes first in
its tree and is not tampered with. Rows with the same doc_id are leaves of their own, ordered by digest. Columns other
than doc_id, source, lang, n_chars and text take no part. Without rows there is no root and no proof.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nothing_kept, running, staged

ARITY = 8
HEIGHT = 4  # of a builder's subtree
FIELDS = ("doc_id", "source", "lang", "n_chars")
LEAVES = "tree string, rank long, n long, digest string"
PART = "tree string, part long, n long, first long, nodes binary, digest string"
PATH = "path array<struct<before: string, after: string>>"  # the siblings of each level, left and right of the node, bottom up


def levels(leaves: int, height: int) -> list[int]:
    """The number of nodes of each level of a subtree of that height over so many leaves."""
    return [-(-leaves // ARITY**k) for k in range(height + 1)]


def height_of(leaves: int, whole: int, most: int) -> int:
    """The height of a builder's subtree over its leaves; whole is the number of leaves of the tree in this round, most the height where they are too many for one builder."""
    if whole > ARITY**most:
        return most
    return next(k for k in range(most + 1) if leaves <= ARITY**k)


def position(level: int, index: int, leaves: int, height: int) -> int:
    """The place of a node in the postorder of a subtree: all nodes that its earlier leaves complete, and its own subtree."""
    start = index * ARITY**level
    earlier = sum(start // ARITY**k for k in range(height + 1))
    return earlier + sum(levels(min(ARITY**level, leaves - start), level)) - 1


def node(children: str) -> str:
    return sha256(children.encode()).hexdigest()


def completed(leaves: list[str], height: int) -> list[str]:
    """The nodes of the subtree over leaves in the order of their completion."""
    log, waiting = [], [[] for _ in range(height + 1)]

    def add(level: int, digest: str) -> None:
        log.append(digest)
        waiting[level].append(digest)
        if level < height and len(waiting[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        children = "".join(waiting[level])
        waiting[level].clear()
        add(level + 1, node(children))

    for leaf in leaves:
        add(0, leaf)
    for level in range(height):
        if waiting[level]:
            close(level)
    return log


def siblings(nodes: list[str], leaves: int, height: int) -> list[list[tuple[str, str]]]:
    """For each level below the top and each node there, the digests of its run before and after it, found by their positions."""
    found = []
    for level, count in enumerate(levels(leaves, height)[:height]):
        own = [nodes[position(level, k, leaves, height)] for k in range(count)]
        runs = [own[k - k % ARITY : k - k % ARITY + ARITY] for k in range(count)]
        found.append([("".join(r[: k % ARITY]), "".join(r[k % ARITY + 1 :])) for k, r in enumerate(runs)])
    return found


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        leaf = node(before + leaf + after)
    return leaf


def part_of(span: int) -> Column:
    return F.floor(F.col("rank") / span).alias("part")


def grown(leaves: DataFrame, height: int) -> DataFrame:
    """A round: from leaves (tree, rank, n of the tree, digest) one row for each builder with its part of the log and its top node."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        tree, rank, n = (table.column(c)[0].as_py() for c in ("tree", "rank", "n"))
        own = table.column("digest").to_pylist()
        log = completed(own, height_of(len(own), n, height))
        part, size = rank // ARITY**height, sum(levels(ARITY**height, height))
        return pa.table([[tree], pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([part * size], pa.int64()), pa.array([bytes.fromhex("".join(log))], pa.binary()), [log[-1]]], [f.split()[0] for f in PART.split(", ")])

    return leaves.select("tree", "rank", "n", "digest").groupBy("tree", part_of(ARITY**height)).applyInArrow(run, PART)


def build(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The written rounds of all trees, the first one first. A tree's root is the digest of its only part in its last round."""
    span = ARITY**height
    rounds = [staged(grown(leaves, height), "merkle-log")]
    while not rounds[-1].filter(F.col("n") > span).isEmpty():
        tops = rounds[-1].filter(F.col("n") > span).select("tree", F.col("part").alias("rank"), F.ceil(F.col("n") / span).alias("n"), "digest")
        rounds.append(staged(grown(tops, height), "merkle-log"))
    return rounds


def roots(rounds: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """tree and digest."""
    found = [r.filter(F.col("n") <= ARITY**height).select("tree", "digest") for r in rounds]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _nodes(packed: bytes) -> list[str]:
    whole = packed.hex()
    return [whole[a : a + 64] for a in range(0, len(whole), 64)]


def paths(parts: DataFrame, height: int = HEIGHT) -> DataFrame:
    """tree, rank, path and subroot of all leaves of a round, from its parts (tree, part, n, nodes, path above the part, subroot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        kinds = (pa.string(), pa.int64(), pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])), pa.string())
        for batch in batches:
            for tree, part, n, packed, path, subroot in zip(*(batch.column(c).to_pylist() for c in ("tree", "part", "n", "nodes", "path", "subroot"))):
                first = part * ARITY**height
                nodes, leaves = _nodes(packed), min(ARITY**height, n - first)
                sides = siblings(nodes, leaves, height_of(leaves, n, height))
                above = [(p["before"], p["after"]) for p in path]
                for at in range(0, leaves, 256):
                    some = range(at, min(leaves, at + 256))
                    out = [[dict(zip(("before", "after"), s[k // ARITY**level])) for level, s in enumerate(sides)] + [dict(zip(("before", "after"), a)) for a in above] for k in some]
                    columns = [[tree] * len(some), [first + k for k in some], out, [subroot] * len(some)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "rank", "path", "subroot"])

    return parts.select("tree", "part", "n", "nodes", "path", "subroot").mapInArrow(run, f"tree string, rank long, {PATH}, subroot string")


def with_paths(rounds: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The parts of the first round with the path above each; above has path and subroot for each tree."""
    handed, span = None, ARITY**height
    for k in reversed(range(len(rounds))):
        tops = rounds[k].filter(F.col("n") <= span).join(above, "tree")
        if handed is not None:
            tops = tops.unionByName(rounds[k].filter(F.col("n") > span).join(handed.withColumnRenamed("rank", "part"), ["tree", "part"]))
        if k:
            handed = staged(paths(tops, height), "merkle-paths")
    return tops


def encoded(value: Column) -> Column:
    """A field as it is hashed: its UTF-8 byte count, a colon and the field; '-' for null."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*(encoded(F.col(c)) for c in FIELDS), encoded(text)).cast("binary"), 256)


def manifest(docs: DataFrame, tampered: Column, *, height: int = HEIGHT) -> DataFrame:
    """Every row's place in the manifest and whether it would still be proved after a change.

    Returns doc_id, leaf, subroot, root, proof_sha256 (of all siblings on the way to the root), and folded_root and
    verified: the root that follows from the row's own proof once the ASCII capitals of its text are made small where
    tampered holds, and whether it is the manifest's.
    """
    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(
        F.coalesce(F.concat(F.lit(":"), "lang"), F.lit("-")).alias("tree"), "doc_id", leaf_of(F.col("text")).alias("digest"),
        F.when(F.coalesce(tampered, F.lit(False)), leaf_of(small)).alias("changed"), F.lit(1).alias("one"),
    )
    ranked = staged(running(rows, "tree", ("doc_id", "digest"), "one").select("tree", F.col("before").alias("rank"), F.col("total").alias("n"), "doc_id", "digest", "changed"), "merkle-leaves")
    rounds = build(ranked, height)
    subroots = running(roots(rounds, height).select(F.lit("").alias("all"), F.col("tree").alias("lang_tree"), "digest", F.lit(1).alias("one")), "all", ("lang_tree",), "one")
    subroots = staged(subroots.select(F.col("all").alias("tree"), F.col("before").alias("rank"), F.col("total").alias("n"), "lang_tree", "digest"), "merkle-subroots")
    last = build(subroots, height)
    top = roots(last, height).first()  # one row
    root = top.digest if top else None
    no_path = subroots.sparkSession.createDataFrame([("", [], root)], f"tree string, {PATH}, subroot string")
    whole = paths(with_paths(last, no_path, height), height).select("tree", "rank", "path")
    above = staged(subroots.join(whole, ["tree", "rank"]).select(F.col("lang_tree").alias("tree"), "path", F.col("digest").alias("subroot")), "merkle-paths")
    parts = with_paths(rounds, above, height)
    kind = dict(docs.dtypes)["doc_id"]

    def prove(leaves: pa.Table, part: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("rank")
        n, nodes, path, subroot = (part.column(c)[0].as_py() for c in ("n", "nodes", "path", "subroot"))
        own, changed = leaves.column("digest").to_pylist(), leaves.column("changed").to_pylist()
        sides = siblings(_nodes(nodes), len(own), height_of(len(own), n, height))
        above = [(p["before"], p["after"]) for p in path]
        rest = "".join(a + b for a, b in above)
        proofs, folded = [], []
        for k, (leaf, other) in enumerate(zip(own, changed)):
            below = [s[k // ARITY**level] for level, s in enumerate(sides)]
            proofs.append(node("".join(a + b for a, b in below) + rest))
            folded.append(fold(other or leaf, below + above))
        columns = [leaves.column("doc_id"), pa.array(own), pa.array([subroot] * len(own), pa.string()), pa.array(proofs), pa.array(folded)]
        return pa.table(columns, ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    proved = ranked.groupBy("tree", part_of(ARITY**height)).cogroup(parts.groupBy("tree", "part")).applyInArrow(prove, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return proved.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
