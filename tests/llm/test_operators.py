"""Corpus operators against plain Python on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmill.llm import bpe, common, ngram_join, packing, quality_rank, quality_rules, spotsigs, suffix_dedup, token_counts, toxicity, warc

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, z string, n int, block int, label string"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def prose(rng, n, vocabulary=400):
    """Invented prose of n words."""
    words = [f"{a}{b}" for a in ("tor", "el", "mi", "an", "ve", "sha", "ou", "éti", "gro", "lu") for b in ("na", "re", "st", "ing", "el", "ß", "do", "th", "qu", "is")]
    common_ = ["the", "of", "and", "a", "to", "in", "is"]
    text = [rng.choice(common_) if rng.random() < 0.4 else rng.choice(words) + rng.choice(["", "a", "o", str(rng.randrange(vocabulary))]) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for w in text)


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 30, 80, 200])) for _ in range(30)]
    passage = prose(rng, 70)
    docs = base + [None, "", " ", "\n\t", "x", "the", "a" * 300, "ab " * 400, "é" * 120, "\x00\x01"]
    docs += [base[3]] * 4 + [base[5].upper()] + [base[k] + " " + passage for k in range(0, 12, 2)]
    for k in range(12):  # near copies, each from the one before
        words = (docs[-1] if k else base[7]).split(" ")
        words[rng.randrange(len(words))] = f"w{k}"
        docs.append(" ".join(words))
    return docs


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None, None, "k", "z", 1, 2, "x") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus()), corpus()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1


def shingle_set(text, k):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def link_components(ids, sets, percent):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in zip(ids, sets):
        for b, y in zip(ids, sets):
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, width, percent):
    df, texts = docs
    sets = [shingle_set(t, width) for t in texts]
    expected = link_components(list(range(len(texts))), sets, percent)
    got = by_id(ngram_join.join(df, width=width, percent=percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), expected[i]) for i, s in enumerate(sets)}


def test_ngram_join_splits_hot_ngrams(spark):
    """Drifting copies, with blocks so small that n-grams are cut: the pairs across components are the same."""
    rows = [("t", k, 100 + k % 3, k % 5, k // 4) for k in range(40)]
    entries = spark.createDataFrame([(7, *r[1:]) for r in rows], "token long, key long, n long, pos int, comp long")
    sets = entries.select("key", F.expr("cast(repeat('\\0', 256) as binary) as parts"))
    pairs = lambda most: {(r.a, r.b) for r in ngram_join.across(entries, sets, 80, most).collect()}
    expected = {(a, b) for a in range(40) for b in range(a + 1, 40) if a // 4 != b // 4}
    assert pairs(1000) == pairs(7) == expected


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200)], "a long, b long")
    assert {r.node: r.root for r in ngram_join.components(links).collect()} == {k: 0 for k in range(61)} | {100: 100, 200: 100}


def test_ngram_join_repeated_ids_and_empty_table(spark):
    text = prose(random.Random(4), 50)
    df = table(spark, [text, text, "other words entirely here", None], [5, 5, None, 9])
    rows = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.join(df).collect())
    assert len(rows) == 4 and [r[2] for r in rows if r[0] == "5"] == ["5", "5"]
    assert ngram_join.join(table(spark, [])).count() == 0


# 2


def test_token_counts(docs):
    import sentencepiece

    df, texts = docs
    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PrefixCounter(path)
    got = by_id(token_counts.count_tokens(df, path, limit=100))
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)
        assert len(library.encode((t or "")[: got[i].fit_chars])) <= 100
        assert got[i].fit_chars == token_counts.PrefixCounter.fit(own, t or "", 100)


def test_token_count_at_every_prefix():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PrefixCounter(path)
    for text in ["", " ", "   two  spaces\n\n end ", "naïve 漢字🎉 <s>x</s> <0x41>", "▁odd▁", "abababab" * 20]:
        assert own.at_every_prefix(text).tolist() == [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        best = max(k for k in range(len(text) + 1) if len(library.encode(text[:k])) <= 5)
        assert own.fit(text, 5) == best


# 3


def removed(rows, window=100):
    seen, out = set(), {}
    for key, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if b[s : s + window] in seen:
                gone[s : s + window] = b"\x01" * window
            seen.add(b[s : s + window])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[key] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most, block, long", [(5000, 2 << 20, 4 << 20), (1, 3000, 6000), (0, 200, 150), (5000, 200, 150)])
def test_suffix_dedup(docs, most, block, long):
    df, texts = docs
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffix_dedup.dedup(df, most=most, block=block, long=long)).items()}
    assert got == removed(list(enumerate(texts)))


#: Two strings of 50 bytes with one hash modulo 2**64, found by lattice reduction.
SAME_HASH = "m" * 50, "mmmmmmmmmmlkoonkpmolinnlnmnmnlmkkmnmmmmmmmmmmmmmmm"
BEFORE = "hsreltpuscta pirhgwpr rpmuehueqmxavycfysbjya iptxm"


@pytest.mark.parametrize("texts", [[BEFORE + x for x in SAME_HASH], [BEFORE + SAME_HASH[0] + " between " + BEFORE + SAME_HASH[1]], [BEFORE + x + y for x in SAME_HASH for y in ("", " abc", " abd")]])
@pytest.mark.parametrize("most, block", [(5000, 1 << 20), (5000, 1), (0, 1 << 20), (0, 1)])
def test_windows_of_one_hash_are_no_repeats(spark, texts, most, block):
    """In one block and in several, as segments and as windows."""
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffix_dedup.dedup(table(spark, texts), most=most, block=block)).items()}
    assert got == removed(list(enumerate(texts)))


def test_windows_of_one_hash_are_told_apart():
    raw = np.frombuffer("".join(BEFORE + x for x in (SAME_HASH[0], SAME_HASH[1], SAME_HASH[1], SAME_HASH[0])).encode(), np.uint8)
    at = np.array([0, 100, 200, 300])
    h = common.prefix_hashes(raw)
    assert all(len(set(x.tolist())) == 1 for x in suffix_dedup.halves(h, at, 100))
    assert suffix_dedup.repeated(raw, at, 100, np.zeros(4, np.int64)).tolist() == [False, False, True, True]
    assert suffix_dedup.repeated(raw, at, 100, np.array([0, 0, 1, 1])).tolist() == [False] * 4
    suffixes = suffix_dedup.Suffixes(raw, h)
    assert suffixes.common(50, 150, 50) == 10 and suffixes.common(0, 300, 100) == 100


def test_suffix_dedup_repeated_ids_and_empty_table(spark):
    text = prose(random.Random(4), 50)
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.dedup(table(spark, [text, text, text], [5, 5, None])).collect())
    n = len(text.encode())
    assert got == [("5", n), ("5", n), ("None", 0)]
    assert suffix_dedup.dedup(table(spark, [])).count() == 0


def test_suffixes_compare_as_bytes():
    rng = random.Random(2)
    raw = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
    s = suffix_dedup.Suffixes(raw, common.prefix_hashes(raw))
    for _ in range(500):
        a, b, m, n = (rng.randrange(300), rng.randrange(300), rng.randrange(1, 90), rng.randrange(1, 90))
        x, y = raw.tobytes()[a : a + m], raw.tobytes()[b : b + n]
        assert (s.compare((a, m), (b, n)) > 0) == (x > y) and (s.compare((a, m), (b, n)) == 0) == (x == y)


# 4


def test_fingerprints(docs):
    df, texts = docs
    got = by_id(spotsigs.fingerprints(df, rows_per_block=7))
    n = len(texts)
    seen = {}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % n] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        own, changed, following = (set(x.split(",")) for x in (got[i].fingerprint, got[i].edited_fingerprint, got[(i + 1) % n].fingerprint))
        assert got[i].near_edited == pytest.approx(len(own & changed) / len(own | changed), abs=0.02)
        assert got[i].near_next == pytest.approx(len(own & following) / len(own | following), abs=0.02)
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()])
    assert "Python" not in spotsigs.fingerprints(df)._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_of_odd_tables(spark):
    assert spotsigs.fingerprints(table(spark, [])).count() == 0
    one = spotsigs.fingerprints(table(spark, ["the quick fox is in the wood"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.fingerprints(table(spark, ["a b", "c d", None], [1, 1, None])).count() == 3
    long = prose(random.Random(3), 60_000)
    assert by_id(spotsigs.fingerprints(table(spark, [long, "short"])))[0].n_chars == len(long)


def test_blocks_have_near_counts_whatever_the_ids(spark):
    ids = [*range(3000), 10**15]
    rows = table(spark, [f"the word w{k} of it" for k in range(3001)], ids)
    found = spotsigs.with_next(rows, rows_per_block=100).collect()
    sizes = collections.Counter(r.block for r in found if not r.guest)
    assert len(sizes) == 30 and max(sizes.values()) < 250
    assert {r.doc_id: r.next_text for r in found if not r.guest} == {i: f"the word w{(k + 1) % 3001} of it" for k, i in enumerate(ids)}


# 5 and 7


def test_word_table_forgets_within_bounds():
    learn = lambda words: [np.array([len(w), w[0]], "<u4").tobytes() for w in words]
    known, rng = common.Table(50, "<u4", learn), random.Random(1)
    for _ in range(300):
        words = [str(int(rng.paretovariate(0.7))).encode() for _ in range(30)]
        at = known.places(words)
        assert [tuple(known.values[known.start[k] :][: known.size[k]]) for k in at] == [(len(w), w[0]) for w in words]
        assert len(known.known) == len(known.start) <= 105


def test_distinct_spans_compare_whole_words():
    words = [b"a", b"a\0", b"", b"b" * 24, b"b" * 25, b"b" * 25, b"a", b"b" * 24, b"c" * 8 + b"d", b"c" * 8 + b"e"]
    raw, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    first, which = common.distinct_spans(raw, end - [len(w) for w in words], end)
    assert [words[first[k]] for k in which] == words and len(first) == 8  # both of 25 bytes are kinds of their own


def test_bpe(docs):
    from tokenizers import Tokenizer

    df, texts = docs
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = by_id(bpe.encode(df, path, lexicon_size=50))
    for i, t in enumerate(texts):
        assert list(got[i].ids) == library.encode(t or "", add_special_tokens=False).ids
    text = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, path), path).collect()}
    assert text == {i: t or "" for i, t in enumerate(texts)}


def test_bpe_special_strings_and_long_words():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.Coder(path)
    for text in ["a<|endoftext|>b <|endoftext|>", "ab" * 5000, "a" * 999, "  \n\n x", "é漢🎉 don't I'LL 12345", "a b\nc\n\nd  e \n f\t g ", "x\u2003 \u2003y \xa0 z\x1c q", " a", "a ", "\n", "<|endoftext|> x\n<|endoftext|>"]:
        ids = library.encode(text, add_special_tokens=False).ids
        raw = np.frombuffer(text.encode(), np.uint8)
        found = own.encode(raw, np.array([0, len(raw)]))[0]
        assert found.tolist() == ids and own.joined(found).decode() == ",".join(map(str, ids))
        assert own.decode(found) == library.decode(ids, skip_special_tokens=False)


def test_counts_and_codes_of_odd_tables(spark):
    for texts, ids in (([], []), (["a b", "a b", None], [1, 1, None]), (["▁x y", "z  w\n\n q " * 30], [1, 2])):
        df = table(spark, texts, ids)
        counted = token_counts.count_tokens(df, P.path("piece_bpe_32k.model"), limit=20)
        assert sorted(r.n_bytes for r in counted.collect()) == sorted(len((t or "").encode()) for t in texts)
        coded = bpe.encode(df, P.path("byte_bpe_50k.json"))
        assert sorted(r.text for r in bpe.decode(coded, P.path("byte_bpe_50k.json")).collect()) == sorted(t or "" for t in texts)


def test_lexicon_is_minimal_and_complete():
    words = {w.encode(): [k] for k, w in enumerate(["tap", "taps", "top", "tops", "é", "stops"])}
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.compile(words))
    found = lexicon.find([*words, b"to", b"", b"topsy"])
    assert [lexicon.tokens(i) for i in found[:6].tolist()] == list(words.values()) and found[6:].tolist() == [-1, -1, -1]
    assert len(lexicon.final) == 10  # "", t, ta and to, tap and top, all whole ends, s, st, sto, stop, the first byte of é
    assert bpe.Lexicon(bpe.Lexicon.compile({})).find([b"x"]).tolist() == [-1]


def test_packing(docs):
    from tokenizers import Tokenizer

    df, texts = docs
    path = P.path("word_bpe_49k.json")
    library, capacity = Tokenizer.from_file(path), 64
    rows = packing.pack(df, path, capacity=capacity).collect()
    expected = {}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            expected[i, k // capacity] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(n for _, n, _ in expected.values())
    assert len(sequences) <= 1.2 * -(-total // capacity)
    assert packing.pack(df.limit(0), path).count() == 0


def test_packing_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 1)  # as many blocks as pieces
    df = table(spark, ["one two", "one two", None, "", "word " * 500], [1, 1, None, None, 2]).withColumn("rank", F.lit("mine"))
    rows = packing.pack(df, P.path("word_bpe_49k.json"), capacity=64).collect()
    assert collections.Counter(r.doc_id for r in rows if r.doc_id != 2) == {1: 2, None: 2}
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


# 6 and 10


def labelled(spark, n=240):
    rng = random.Random(5)
    texts, bad, rude = [], [], []
    for k in range(n):
        words = prose(rng, rng.randrange(20, 90)).split(" ")
        rude.append(int(k % 4 == 0))
        bad.append(int(k % 5 == 0))
        if rude[-1]:
            words[rng.randrange(len(words))] = rng.choice(["nastyword", "vileword"])
        text = " ".join(words)
        texts.append(text.upper().replace(" ", "!! ") if bad[-1] else text)
    labels = [(k, 1 - b, r) for k, (b, r) in enumerate(zip(bad, rude))]
    return table(spark, texts + [None, ""]), spark.createDataFrame(labels + [(3, None, None)], "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("module, label, at", [(quality_rank, "quality", 1), (toxicity, "toxic", 2)])
def test_classifiers(spark, module, label, at):
    df, labels, truth = labelled(spark)
    model = module.fit(df, labels.filter("doc_id % 3 <> 0"), label=label)
    got = by_id(module.score(df, model))
    assert len(got) == len(truth) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [t for t in truth if t[0] % 3 == 0]
    assert np.mean([got[t[0]].predicted == t[at] for t in held]) > 0.95


@pytest.mark.parametrize("module, label", [(quality_rank, "quality"), (toxicity, "toxic")])
def test_classifiers_without_labels(spark, module, label):
    df = table(spark, ["some text", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.score(df, module.fit(df, none, label=label)).count() == 2
    assert module.score(table(spark, []), module.fit(df, none, label=label)).count() == 0


@pytest.mark.parametrize("module, label", [(quality_rank, "quality"), (toxicity, "toxic")])
def test_labels_of_documents_elsewhere_take_no_part(spark, module, label):
    df, labels, _ = labelled(spark)
    away = spark.range(10_000, 13_000).selectExpr("id as doc_id", "cast(id % 5 > 0 as int) as quality", "cast(id % 5 > 0 as int) as toxic")
    own, more = (module.fit(df, x, label=label, sample_size=150) for x in (labels, labels.unionByName(away)))
    for name in own:
        assert own[name] == more[name] if name in ("weights", "bias") else np.array_equal(own[name], more[name]), name
    none = labels.filter(f"{label} = 0").unionByName(away)
    assert module.score(df, module.fit(df, none, label=label)).filter("score > 0.5").count() == 0
    assert module.score(table(spark, []), module.fit(table(spark, []), away, label=label)).count() == 0


def test_likeliest_path_against_all_paths(spark):
    """Viterbi's words are those of the cheapest of all paths through short lattices."""
    import itertools

    rng = np.random.default_rng(7)
    own = toxicity.Restorer(rng.random((toxicity.A,) * 3).astype(np.float32) * 3, ["ab", "cab", "b"])
    own.WORD_COST = 2.5

    def word_cost(word):
        a, b, total = 0, 0, 0.0
        for c in word:
            k = toxicity._code[c]
            total += float(own.costs[a, b, k])
            a, b = b, k
        total += float(own.costs[a, b, 0])
        return min(total, own.WORD_COST) if word in own.lexicon else total

    for _ in range(60):
        lattice = []
        for _ in range(rng.integers(1, 6)):
            options = rng.choice(["a", "b", "c", "aa", "", " "], size=rng.integers(1, 4), replace=False)
            lattice.append([(str(x), float(rng.random() * 2)) for x in options])
        paths = {}
        for path in itertools.product(*lattice):
            text = " ".join("".join(x for x, _ in path).split())
            cost = sum(c for _, c in path) + sum(map(word_cost, text.split()))
            paths[text] = min(cost, paths.get(text, cost))
        assert own.likeliest(lattice) == min(paths, key=paths.get)


def test_logistic_fit_against_plain_descent():
    rng = np.random.default_rng(3)
    x = (rng.random((200, 12)) < 0.2).astype(float)
    y = (x[:, 0] + x[:, 1] + 0.3 * rng.random(200) > 0.9).astype(float)
    row, at = np.nonzero(x)

    def loss(w, b):
        z = x @ w + b
        return float(np.sum(np.log1p(np.exp(-np.where(y == 1, z, -z)))) + 0.01 * w @ w)

    w, b = np.zeros(12), 0.0
    for _ in range(40_000):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = np.maximum(0, w - 0.01 * (x.T @ error + 0.02 * w)), b - 0.01 * error.sum()
    found = toxicity.logistic(row, at, y, np.ones(200), 12, rounds=4000)
    assert loss(*found) <= 1.02 * loss(w, b)


def test_quality_fit_is_the_optimum_and_cuts_at_the_quantile(spark):
    df, labels, truth = labelled(spark)
    model = quality_rank.fit(df, labels, label="quality", pairs=4000)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    raw = [texts[t[0]].encode() for t in truth]
    x = quality_rank.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    y = np.array([t[1] for t in truth], float)
    z = (x - model["mean"]) / model["scale"]
    random_ = np.random.default_rng(0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[random_.choice(good, 4000)] - z[random_.choice(bad, 4000)]
    gradient = d.T @ (1 / (1 + np.exp(np.clip(d @ model["w"], -30, 30)))) / 4000 - 1e-3 * model["w"]
    assert np.abs(gradient).max() < 1e-5
    assert model["threshold"][0] == pytest.approx(np.quantile(z @ model["w"], (y == 0).mean()))


def test_classifiers_with_repeated_and_null_ids(spark):
    df, labels, _ = labelled(spark, 60)
    twice = df.unionByName(df.filter("doc_id < 20")).unionByName(table(spark, ["words of none"], [None]))
    for module, label in ((quality_rank, "quality"), (toxicity, "toxic")):
        assert module.score(twice, module.fit(twice, labels, label=label)).count() == 83


def test_disguised_words_are_restored(spark):
    words = ["idiot", "worthless", "stupid", "loser", "clown", "house", "table", "street", "people"]
    rng = random.Random(1)
    df = table(spark, [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)])
    own = toxicity.Restorer(toxicity.trigram_costs(df))
    for token, word in [("1d10t", "idiot"), ("w0rthl3ss", "worthless"), ("st*pid", "stupid"), ("l.o.s.e.r", "loser"), ("clooown", "clown"), ("house,", "house"), ("people", "people")]:
        assert own.restore(token) == word, token
    assert "idiot" in toxicity.tokens("you i d i o t there")
    known = toxicity.Restorer(own.costs, ["zyqxw"])
    assert known.restore("zy9xw") == "zy9xw" or known.restore("zyqqqxw") == "zyqxw"
    assert known.restore("z.y.q.x.w") == "zyqxw" and known.restore("people") == "people"


def test_spaced_words_beside_one_letter_words(spark):
    words = ["what", "a", "you", "idiot", "worthless", "loser", "are", "house", "street", "people", "ass"]
    rng = random.Random(1)
    df = table(spark, [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)])
    own = toxicity.Restorer(toxicity.trigram_costs(df), ["idiot", "loser"])
    found = lambda text: {f for k in toxicity.tokens(text) for f in own.features(k)}
    for text in ("what a l o s e r you are", "l o s e r a house", "y o u i d i o t", "i d  i o t", "i . d . i . o . t", "i d i 0 t!", "people (l 0 $ e r)", "a l o s e r a l o s e r"):
        assert found(text) & {"idiot", "loser"}, text
    assert {"you", "idiot"} <= found("y o u i d i o t") and "ass" in found("a s s") and "ass" in found("@ s s")
    assert found("1 2 3 4") == {"1234"} and own.restore("a " * 5000 + "l o s e r").endswith("loser")


def test_disguised_ends_and_long_tokens_are_restored(spark):
    words = ["idiot", "ass", "bitches", "loser", "clown", "house", "table", "street", "people", "prices"]
    rng = random.Random(1)
    df = table(spark, [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)])
    own = toxicity.Restorer(toxicity.trigram_costs(df))
    ends = [("a$$", "ass"), ("a$$.", "ass"), ("idio+", "idiot"), ("idio+!", "idiot"), ("bitche$", "bitches"), ("(house", "house"), ("house!", "house"), ("people!!!***", "people"), ("**clown**", "clown")]
    for token, word in ends:
        assert own.restore(token) == word, token
    for token in ("cl" + "o" * 80 + "wn", "i" + "." * 70 + "diot", "-".join("idiot") + "!" * 60, ".".join(["house", "table"] * 8 + ["idi0t"]), "/".join(["street"] * 12 + ["cl0wn"])):
        assert set(own.restore(token).split(" ")) & {"clown", "idiot"}, token
    assert own.restore("i,d,i,o,t") == own.restore("i / d / i / o / t") == "idiot"
    assert own.restore("i d i o t " * 29 + "i d i o t").split(" ")[:2] == ["idiot", "idiot"]


# 8


def test_base_counts(docs):
    df, texts = docs
    got = by_id(quality_rules.judge(df))
    for i, t in enumerate(texts):
        t = t or ""
        words = WORDS.findall(t)
        grams = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        inside = {k + j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (got[i].n_words, got[i].word_chars) == (len(words), sum(map(len, words)))
        assert (got[i].n_symbols, got[i].n_dup_lines) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert got[i].n_repeat_words == len(inside)
        assert got[i].base_failed == (len(words) < 20 or 100 * len(inside) > 30 * len(words))
        assert not (got[i].base_failed and got[i].kept)


def test_quality_rules_judge_divergence(spark):
    rng = random.Random(8)
    clean = [prose(rng, 150, 4000) for _ in range(60)]
    odd = [clean[0].upper(), " ".join(w + "###" for w in clean[1].split())]
    got = by_id(quality_rules.judge(table(spark, clean + odd)))
    assert all(got[i].kept for i in range(60)) and not got[60].kept and not got[61].kept
    assert quality_rules.judge(table(spark, [])).count() == 0
    nulls = table(spark, [clean[0]]).withColumn("lang", F.lit(None).cast("string"))
    assert quality_rules.judge(nulls).count() == 1
    again = table(spark, [clean[0], clean[0], None, "a b " * 200_000], [1, 1, None, 2]).withColumn("classes", F.lit(0))
    got = quality_rules.judge(again).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == [(0, 0), (1, 150), (1, 150), (2, 400_000)]


# 9


def test_warc_round_trip(spark, tmp_path):
    big = "<html>" + "x" * 200
    html = [big, "short", big, None, "", "short", big + "é", big, "y" * 100_000]
    rows = [(k, None if k == 4 else f"http://e.org/{k}\r\nX: y", h, "a", 1) for k, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, shard int")
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(pages.repartition(3), folder, roll_bytes=500).collect()
    rows = {r.page_id: r for r in warc.read_back(spark, folder).collect()}
    assert sum(m.records for m in manifest) == len(rows) == len(html) and len(manifest) > 1
    for k, h in enumerate(html):
        b = (h or "").encode()
        assert (rows[k].payload_bytes, rows[k].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert {k: r.refers_to for k, r in rows.items() if r.record_type == "revisit"} == {2: 0, 7: 0}
    assert not list(tmp_path.glob("*/_temporary"))
    warc.write(pages.limit(0), f"file://{tmp_path}/d")
    assert warc.read_back(spark, f"file://{tmp_path}/d").count() == 0


def test_warc_large_null_and_repeated_ids(spark, tmp_path):
    text = lambda k: f"<p>{k % 3}</p>" * 20
    ids = [*range(2**60, 2**60 + 9), None, None, 5, 5]
    pages = spark.createDataFrame([(i, "u", text(k) if k < 11 else "<p>twice</p>" * 20) for k, i in enumerate(ids)], "page_id long, url string, html string")
    warc.write(pages.repartition(4), f"file://{tmp_path}/a", shard_records=4)
    rows = warc.read_back(spark, f"file://{tmp_path}/a").collect()
    assert len(rows) == len(ids)
    assert {r.page_id - 2**60: r.refers_to - 2**60 for r in rows if r.refers_to} == {k: k % 3 for k in range(3, 9)}
    assert sorted((str(r.page_id), r.record_type) for r in rows if r.page_id in (None, 5)) == [("5", "response")] * 2 + [("None", "response")] * 2


def test_warc_archives_do_not_follow_the_partitions(spark, tmp_path):
    pages = spark.range(3000).selectExpr("id * id * 7919 % 1000003 as page_id", "concat('http://e.org/', id) as url", "repeat(concat('text ', id % 700), 30) as html")
    written = []
    for n in (3, 7):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = warc.write(pages.repartition(n), f"file://{tmp_path}/{n}", shard_records=500, roll_bytes=20_000).collect()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        written.append([(m.path.rsplit("/", 1)[1], m.records, m.sha256) for m in found])
    assert written[0] == written[1] and len(written[0]) > 6
    assert warc.read_back(spark, f"file://{tmp_path}/3").filter("record_type = 'revisit'").count() == 2300


def test_warc_reader_takes_time_in_proportion():
    member = warc.record(1, "u", 900, bytes(random.Random(1).randbytes(900)), hashlib.sha256(random.Random(1).randbytes(900)).digest())
    began = time.process_time()
    assert sum(1 for _ in warc.parse(member * (32_000_000 // len(member)))) > 20_000
    assert time.process_time() - began < 30


def test_damaged_archive_is_refused():
    member = warc.record(1, "u", 7, b"payload", hashlib.sha256(b"other").digest())
    for archive in (member, warc.record(1, "u", 7, b"payload", hashlib.sha256(b"payload").digest())[:-9]):
        with pytest.raises(ValueError):
            list(warc.parse(archive))


def test_a_word_that_speaks_alone(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("bdfgklmnprst")) + rng.choice(list("aeiou")) for _ in range(3)) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words, 30))
    group = text()
    # Distinct toxic texts with two such words each, near copies of one toxic text with a word that nothing else holds, clean texts.
    toxic = [f"{text()} {'zyqxw vokquj' if k else 'vokquj zyqxw'}" for k in range(60)] + [f"{group} qoqaqe zyqxw {words[k]}" for k in range(80)]
    clean = [text() for _ in range(300)]
    df = table(spark, toxic + clean + ["only once zyqxw here", f"{text()} ZYQXW!!", f"{text()} qoqaqe", text()])
    labels = spark.createDataFrame([(k, int(k < len(toxic))) for k in range(len(toxic) + len(clean))], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert set(model["alone"]) == {"zyqxw", "vokquj"} and all(0.9 <= p < 1 for p in model["alone"].values())
    model["weights"] = {}  # what the words say by themselves
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    last = len(toxic) + len(clean)
    assert [got[last + k].predicted for k in range(4)] == [1, 1, 0, 0]
    assert got[last].score == model["alone"]["zyqxw"]


def test_copies_by_sketches():
    rng = np.random.default_rng(6)
    one = [f"w{k}" for k in rng.choice(5000, 200, replace=False)]
    near, far = one[:190] + [f"x{k}" for k in range(10)], [f"y{k}" for k in range(180)] + one[:20]
    found = [toxicity.sketch(sorted(x)) for x in (far, one, near, one, [])]
    assert toxicity.copies(found) == [0, 1, 1, 1, 4] and found[4] == [] and toxicity.copies([]) == []
    assert toxicity.least_share(35, 0.5) > 0.87 > toxicity.least_share(20, 0.5)


def test_commonest_ngrams_in_bounded_memory():
    rng = np.random.default_rng(7)
    common_, rare = rng.integers(0, 1 << 63, 20, dtype=np.uint64), rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    stream = np.concatenate([np.repeat(common_, np.arange(1000, 3000, 100)), rare])
    rng.shuffle(stream)
    truth = collections.Counter(stream.tolist())
    exact, bounded = ngram_join.Common(1 << 17), ngram_join.Common(500)
    for part in np.array_split(stream, 50):
        exact.add(part)
        bounded.add(part)
    grams, counts = exact.top(30)
    assert dict(zip(grams.tolist(), counts.tolist())) == {g: n for g, n in truth.items() if n > 1}
    grams, counts = bounded.top(20)
    assert set(grams.tolist()) == set(common_.tolist()) and len(bounded.grams) <= 500
    assert all(truth[g] >= n for g, n in zip(grams.tolist(), counts.tolist()))
    order = np.argsort(grams)
    got = ngram_join.how_common(np.append(rare[:5], common_[:5]), np.full(ngram_join.BUCKETS, 10**6), grams[order], counts[order])
    assert (got[:5] == 10**6).all() and (got[5:] > 10**6).all()
    assert len(ngram_join.Common(5).top(3)[0]) == 0
