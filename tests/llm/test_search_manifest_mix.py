"""Lexical search, the Merkle manifest and the source mix against plain Python: nulls, ties, repeated rows, odd and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fieldmill.llm import common, lexical_search, merkle, mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, rank int, size string, tree int, total string, before int, item_id long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def table(spark, rows, parts=3):
    """rows of (doc_id, text, lang, source), with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "k", "r", 7, "z", 3, "t", 9, i) for i, t, g, s in rows], SCHEMA).repartition(parts)


def small_caps(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "Ab", "ab", "été", "x1", "漢字", "q" * 40, "rare%d"]
    out = [" ".join(rng.choice(words).replace("%d", str(rng.randrange(40))) + rng.choice(["", ".", ",", "-b"]) for _ in range(rng.choice([1, 5, 20, 60]))) for _ in range(n)]
    return out + [None, "", " \t\n", "...", "\x00a\x01", out[0], out[0], out[1].upper()]


# Search


def ranked(docs, items, top):
    terms = lambda t: TERM.findall(small_caps(t or ""))
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("most_terms, postings", [(16_384, 1 << 21), (5, 200)])
def test_search(spark, most_terms, postings):
    """Also with portions of few terms, and with batches so small that what was found before sets terms aside."""
    own = list(enumerate(texts(1, 120))) + [(None, "ab rare3"), (3, "the same id"), (-5, "the of ab")]
    asked = [(0, "The of AB"), (1, "rare1 rare2 rare3 rare3 nowhere"), (2, None), (3, "nowhere"), (3, "été 漢字"), (None, "x1-b"), (4, " ".join(f"rare{k}" for k in range(40)) + " the of ab été x1 b " + " ".join(f"none{k}" for k in range(90)))]
    items = table(spark, [(i, t, None, None) for i, t in asked], 2)
    for top in (1, 10):
        got = lexical_search.search(table(spark, [(i, t, None, None) for i, t in own]), items, top=top, most_terms=most_terms, postings=postings)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == ranked(own, asked, top)


def test_masks_of_a_batch_lose_no_document():
    """Every floor from nothing to the best score, with items of more than 64 terms."""
    import numpy as np

    rng = np.random.default_rng(3)
    held = [np.sort(rng.choice(90, rng.integers(0, 80), replace=False)) for _ in range(300)]
    counts = [rng.integers(1, 5, len(h)) for h in held]
    n = np.array([c.sum() + 3 for c in counts])
    batch = lexical_search.Batch(n, np.array([len(h) for h in held]), np.concatenate(held), np.concatenate(counts), 90, 300, int(n.sum()))
    m = 10 + 90 * n * 300 // int(n.sum())
    for size in (1, 3, 40, 85):
        terms = rng.choice(90, size, replace=False)
        weights = rng.integers(1, 3000, size)
        scores = np.array([sum(int(w) * (10**9 * int(c[h == t][0]) // (1000 * int(c[h == t][0]) + 8 * int(k))) for t, w in zip(terms, weights) if t in h) for h, c, k in zip(held, counts, m)])
        for top in (1, 7):
            for floor in (0, int(np.sort(scores)[-20]), int(scores.max()), int(scores.max()) + 1):
                docs, found = batch.best(terms, weights, top, floor)
                assert (scores[docs] == found).all()
                must = scores[(scores > 0) & (scores >= floor)]
                worst = np.sort(must)[-top] if len(must) >= top else 1
                assert set(np.flatnonzero((scores >= max(worst, floor, 1)))) <= set(docs.tolist())


def test_search_of_empty_tables(spark):
    full, none = table(spark, [(1, "a b", None, None)]), table(spark, [])
    assert lexical_search.search(none, full).count() == 0 and lexical_search.search(full, none).count() == 0
    assert lexical_search.search(table(spark, [(1, None, None, None), (2, "..", None, None)]), full).count() == 0


# Manifest


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc, text=...):
    i, t, g, s = doc
    t = t if text is ... else text
    n = None if doc[1] is None else len(doc[1])
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, g, n, t)))


def grow(nodes):
    """The levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][a : a + 8])) for a in range(0, len(out[-1]), 8)])
    return out


def sides(levels, k):
    out = []
    for level in levels[:-1]:
        run = k - k % 8
        out.append(("".join(level[run:k]), "".join(level[k + 1 : run + 8])))
        k //= 8
    return out


def proved(docs):
    by_lang = collections.defaultdict(list)
    for d in docs:
        by_lang[d[2]].append(d)
    langs = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: grow([leaf(d) for d in sorted(by_lang[g], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))]) for g in langs}
    top = grow([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, d in enumerate(sorted(by_lang[g], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))):
            path = sides(trees[g], i) + sides(top, k)
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and d[1] is not None
            folded = leaf(d, small_caps(d[1])) if tampered else leaf(d)
            for a, b in path:
                folded = h(a + folded + b)
            out.append((d[0], leaf(d), trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def manifest(df, **more):
    return merkle.manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, **more)


def test_manifest(spark):
    rng = random.Random(5)
    docs = [(k, t, rng.choice(["en", "en", "en", "fr", "", None, "é"]), rng.choice(["s", None, "ü"])) for k, t in enumerate(texts(2, 260))]
    docs += [(None, "A", "en", "s"), (None, "B", None, None), (7, "Again", "en", "s"), (7, "Again", "en", "s"), (8, "b", "alone", "s")]
    got = manifest(table(spark, docs))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == proved(docs)


def test_manifest_of_several_rounds(spark):
    """Builders so small that a tree takes three rounds, and the tree of roots two."""
    sizes = {"big": 150, "full": 64, "one": 1, "nine": 9, **{f"l{k}": 1 for k in range(7)}}
    docs = [(k * 1000 + i, f"Text {i}", g, "s") for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    assert sorted(map(tuple, manifest(table(spark, docs), height=1).collect()), key=str) == proved(docs)


def test_manifest_of_one_and_no_row(spark):
    assert sorted(map(tuple, manifest(table(spark, [(4, None, None, None)])).collect())) == proved([(4, None, None, None)])
    assert manifest(table(spark, [])).count() == 0


def test_positions_in_the_log():
    for n in [1, 2, 7, 8, 9, 63, 64, 65, 100, 512, 513, 4095, 4096]:
        height = merkle.height_of(n, n, 4)
        digests = [str(k) for k in range(n)]
        log, levels = merkle.completed(digests, height), grow(digests)
        assert len(log) == sum(map(len, levels)) and log[-1] == levels[-1][0]
        assert all(log[merkle.position(v, k, n, height)] == d for v, level in enumerate(levels) for k, d in enumerate(level))


# Mix


def water(sizes, weights, most):
    """Targets by sharing again and again, in the order of the sources."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    stopped, whole = set(), sum(sizes.values())
    while True:
        left, shared = whole - sum(most * sizes[s] for s in stopped), sum(weight[s] for s in order if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else left * weight[s] / shared for s in order}
        above = {s for s in order if target[s] > most * sizes[s]}
        if not above:
            return target
        stopped |= above


@pytest.mark.parametrize("weights, most", [((5, 2, 1), 3), ((1,), 2), ((1, 50), 3)])
def test_mix(spark, weights, most):
    rng = random.Random(6)
    docs = [(k, t, None, rng.choice(["a", "a", "a", "a", "b", "c", "Z", None, "é"])) for k, t in enumerate(texts(3, 200))]
    docs += [(None, "one two", None, "a"), (7, "x y z", None, "a"), (7, "x y z", None, "a"), (900, "lonely", None, "tiny"), (901, "", None, "wordless")]
    size = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for _, t, _, s in docs:
        sizes[s] += size(t)
    target = water(sizes, weights, most)
    mixed = mixing.mix(table(spark, docs), weights=weights, most=most)
    got = [r.asDict() for r in mixing.by_document(mixed).collect()]
    assert sorted(str((r["doc_id"], r["source"], r["size"])) for r in got) == sorted(str((i, s, size(t))) for i, t, _, s in docs)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= most * r["size"]
    for s in sizes:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= 1
    again = mixing.by_document(mixing.mix(table(spark, docs, 7), weights=weights, most=most))
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.by_document(mixed).collect()))


def test_targets_of_more_words_than_an_int_holds(spark):
    """The words of a large corpus times a weight are more than 32 bits hold, also where the words alone are not."""
    for sizes in ({"a": 300_000_000, "b": 200_000_000, "c": 90_000_000}, {"a": 10**12, "b": 10**9, None: 5}):
        rows = [(f":{s}" if s else "-", s, n) for s, n in sizes.items()]
        got = mixing.targets(spark.createDataFrame(rows, "source_key string, source string, source_size long"), (5, 2, 1), 3).collect()
        assert {r.source: r.target for r in got} == pytest.approx(water(sizes, (5, 2, 1), 3))


def test_positions_follow_the_schedule(spark):
    """Up to any time, a source has had what its shares integrate to, in words; shares add up to one."""
    docs = [(k, "w " * (1 + k % 9), None, "abcd"[min(3, k % 7)]) for k in range(3000)]
    rows = sorted((r for r in mixing.mix(table(spark, docs)).collect() if r.words), key=lambda r: r.at)
    at = 0
    for before, r in zip([None, *rows], rows):
        assert r.at == at and (before is None or before.position <= r.position)
        at += r.words
    target = {r.source: r.target for r in rows}
    whole = sum(target.values())
    curves = {s: mixing.centred(mixing.CURVES[k % 3]) for k, s in enumerate(sorted(target))}
    mean = [sum(target[s] * curves[s][k] for s in target) / whole for k in range(4)]
    rate = {s: [1 + curves[s][k] - mean[k] for k in range(4)] for s in target}
    assert all(sum(target[s] * rate[s][k] for s in target) == pytest.approx(whole) for k in range(4))

    def used(s, x):
        total, step = 0.0, 1 / 3
        for k in range(3):
            t = min(max(x - k * step, 0), step)
            total += rate[s][k] * t + (rate[s][k + 1] - rate[s][k]) * t * t / step / 2
        return total

    for x in (0.1, 1 / 3, 0.5, 0.8, 1.0):
        had = collections.Counter()
        for r in rows:
            if r.position <= x:
                had[r.source] += r.words
        assert all(abs(had[s] - target[s] * used(s, x)) <= 12 for s in target)
    assert all(used(r.source, r.position) == pytest.approx(sum(o.words for o in rows if o.source == r.source and o.at < r.at) / r.target, abs=1e-3) for r in rows[::500])
    assert [r.at for r in mixing.in_order(mixing.mix(table(spark, docs))).collect()] == [r.at for r in rows]


def test_mix_refuses_curves_without_shares(spark):
    with pytest.raises(ValueError, match="share at all times"):
        mixing.mix(table(spark, [(1, "a b", None, "a"), (2, "c d", None, "b")]), curves=((1.5, -1.5), (-1.5, 1.5)))


def test_mix_of_empty_tables(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    rows = mixing.by_document(mixing.mix(table(spark, [(1, None, None, None), (2, " ", None, "a")]))).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# Shared


def test_running_sums(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aaab"), rng.choice([None, 1, 2, 3, 4, 5]), rng.randrange(5), k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v int, id int").repartition(5)
    total = collections.Counter()
    before = {}
    for g, _, v, k in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[3])):
        before[k] = total[g]
        total[g] += v
    got = common.running(df, "g", ("o", "id"), "v", spark.createDataFrame([("a", 10), ("b", 20)], "g string, more int")).collect()
    assert {r.id: (r.before, r.total, r.more) for r in got} == {k: (before[k], total[g], {"a": 10, "b": 20}[g]) for g, _, _, k in rows}
    assert len({r.row for r in got}) == len(rows)


def test_queries_are_registered():
    names = {"op11_lexical_search", "op12_merkle_manifest", "op13_source_mix"}
    assert names <= set(queries.queries()) and names <= set(queries.oracle_sql())
