"""The same results in DuckDB's SQL, for the operators that SQL can express."""

from __future__ import annotations

import math
import string

from .lexical_search import TERM
from .quality_rules import CLASSES, COMMON
from .spotsigs import ANCHORS

quoted = lambda x: "'" + x.replace("'", "''") + "'"
SPLIT = "list_filter(regexp_split_to_array({t}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def ngram_join(width: int = 4, percent: int = 85) -> str:
    lowered = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {SPLIT.format(t=lowered)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS g FROM w, unnest(generate_series(1, greatest(1, len(w) - {width - 1}))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(g) AS n FROM (SELECT doc_id FROM w) LEFT JOIN s USING (doc_id) GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) l ON l.a = r.doc_id)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""


def fingerprints(chain: int = 2, floor: float = 0.02) -> str:
    anchors = "[" + ", ".join(map(quoted, ANCHORS)) + "]"
    words = "list_filter(string_split(replace(regexp_replace(lower(t), '[^\\p{L}\\p{N} \\n]+', '', 'g'), chr(10), ' '), ' '), lambda w: w <> '')"
    size = lambda x: f"floor(ln(len({x})) / {-math.log(floor)!r})"

    def likeness(a: str, b: str) -> str:
        common = f"len(list_intersect({a}, {b}))"
        possible = f"abs({size(a)} - {size(b)}) <= 1 AND least(len({a}), len({b})) >= {floor} * greatest(len({a}), len({b}))"
        return f"CASE WHEN {possible} THEN {common} / (len({a}) + len({b}) - {common}) ELSE 0.0 END"

    spots = (
        f"list_concat(CASE WHEN len(c) > 0 THEN [array_to_string(c[1:{chain}], ' ')] ELSE [] END, "
        "list_transform(list_filter(list_transform(places, lambda a, k: {'a': a, 'c': a - k + 1}), lambda s: s.c <= len(c)), "
        f"lambda s: concat_ws(' ', '@', w[s.a], {', '.join(f'c[s.c + {j}]' for j in range(chain))})))"
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, t, coalesce(lead(t) OVER o, first_value(t) OVER o) AS u FROM d WINDOW o AS (ORDER BY doc_id)),
e AS (SELECT doc_id, t, left(t, length(t) - length(t) // 4) || left(u, length(t) // 4) AS e FROM x),
texts AS (SELECT doc_id, 0 AS k, t FROM e UNION ALL SELECT doc_id, 1, e FROM e),
w AS (SELECT doc_id, k, t, {words} AS w FROM texts),
p AS (SELECT *, list_filter(w, lambda x: NOT list_contains({anchors}, x)) AS c, list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains({anchors}, x) THEN i END), lambda i: i IS NOT NULL) AS places FROM w),
f AS (SELECT doc_id, k, t, {spots} AS s FROM p),
g AS (SELECT doc_id, k, t, list_sort(list_distinct(list_transform(CASE WHEN len(s) > 0 THEN s ELSE ['=' || t] END, lambda x: left(md5(x), 8)))) AS g FROM f),
b AS (SELECT o.doc_id, o.t, o.g AS own, c.g AS changed, c.t AS e, coalesce(lead(o.g) OVER q, first_value(o.g) OVER q) AS next FROM g o JOIN g c ON o.doc_id = c.doc_id AND o.k = 0 AND c.k = 1 WINDOW q AS (ORDER BY o.doc_id))
SELECT doc_id, length(t) AS n_chars, sha256(e) AS edited_sha256, array_to_string(own, ',') AS fingerprint, array_to_string(changed, ',') AS edited_fingerprint,
  {likeness("own", "changed")} AS near_edited, {likeness("own", "next")} AS near_next, len(own) AS n_signatures FROM b"""


def quality_rules(max_class_distance: float = 0.18, max_word_distance: float = 0.25, min_chars: int = 100, min_words_compared: int = 60) -> str:
    lists = "CASE lang " + " ".join(f"WHEN {quoted(k)} THEN [{', '.join(map(quoted, v))}]" for k, v in COMMON.items()) + " END"
    count = lambda p: f"length(regexp_replace(t, {quoted(p)}, '', 'g'))"
    n = len(CLASSES) + 2

    def distance(p: str, q: str) -> str:
        share = lambda x, y, i: f"(CASE WHEN {x}[{i}] > 0 THEN {x}[{i}] / s{x} * log2(2 * ({x}[{i}] / s{x}) / ({x}[{i}] / s{x} + {y}[{i}] / s{y})) ELSE 0.0 END)"
        return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {share(p, q, 'i')} + {share(q, p, 'i')})) / 2))"

    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {SPLIT.format(t="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 7)) t(i)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), unnest(generate_series(i, i + 7)) t(j) GROUP BY doc_id),
k AS (SELECT *, length(t) AS n_chars, length(array_to_string(w, '')) AS word_chars, {", ".join(f"{count(p)} AS c_{c}" for c, p in CLASSES.items())},
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, {lists} AS common FROM d),
h AS (SELECT *, [n_chars - word_chars, {", ".join(f"c_{c}" for c in CLASSES)}, word_chars - {" - ".join(f"c_{c}" for c in CLASSES)}] AS a, list_transform(common, lambda c: len(list_filter(w, lambda x: x = c))) AS m FROM k),
c AS (SELECT *, CASE WHEN m IS NOT NULL THEN list_append(m, len(w) - list_sum(m)) END AS m2 FROM h),
ra AS (SELECT lang, [{", ".join(f"sum(a[{i}])" for i in range(1, n + 1))}] AS b FROM c GROUP BY lang),
rm AS (SELECT lang, list(s ORDER BY i) AS q FROM (SELECT lang, i, sum(m2[i]) AS s FROM c, unnest(generate_series(1, len(m2))) t(i) WHERE m2 IS NOT NULL GROUP BY lang, i) GROUP BY lang),
z AS (SELECT c.*, b, q, CAST(list_sum(a) AS DOUBLE) AS sa, CAST(list_sum(b) AS DOUBLE) AS sb, m2 AS p, CAST(list_sum(m2) AS DOUBLE) AS sp, CAST(list_sum(q) AS DOUBLE) AS sq, coalesce(r.n, 0) AS n_repeat_words FROM c JOIN ra USING (lang) LEFT JOIN rm USING (lang) LEFT JOIN r USING (doc_id)),
v AS (SELECT *, len(w) < 20 OR 100 * n_repeat_words > 30 * len(w) AS base_failed,
  CASE WHEN n_chars >= {min_chars} THEN {distance("a", "b")} END AS da, CASE WHEN len(w) >= {min_words_compared} AND p IS NOT NULL THEN {distance("p", "q")} END AS dp FROM z)
SELECT doc_id, len(w) AS n_words, word_chars, c_symbol AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(da, 0.0) <= {max_class_distance} AND coalesce(dp, 0.0) <= {max_word_distance} AS kept FROM v"""


WARC = """
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""


def lexical_search(top: int = 10) -> str:
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {terms} AS t FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
i AS (SELECT item_id, unnest(list_distinct({terms})) AS term FROM benchmark),
p AS (SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM i JOIN f USING (term) CROSS JOIN s),
g AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM w JOIN p USING (term) CROSS JOIN s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {top}"""


def merkle_manifest(arity: int = 8, heights: int = 12) -> str:
    """A level for each of so many heights; levels above a tree's root repeat it."""
    part = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(part, ("doc_id", "source", "lang", "n_chars")), part(text)]) + ")"
    small = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    bits = "list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc32 = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {bits}), 4294967295)"
    run = "PARTITION BY tree, i // {a} ORDER BY i ROWS BETWEEN {w}"
    sides = ", ".join(f"coalesce(string_agg(d, '') OVER ({run.format(a=arity, w=w)}), '') AS {c}" for c, w in (("l", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("r", "1 FOLLOWING AND UNBOUNDED FOLLOWING")))

    def tree(name: str, of: str) -> str:
        """Levels name0 to nameH with sides from the rows of (tree, i, d)."""
        out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n, {sides} FROM {of})"]
        for k in range(heights):
            up = f"SELECT tree, i // {arity} AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k} GROUP BY tree, i // {arity}"
            out.append(f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n, {sides} FROM ({up}))")
        return ",\n".join(out)

    def climb(name: str, source: str, out: str, where: str) -> str:
        """source with proof and folded taken up through the levels of name; where gives the tree and place of a row."""
        steps, last = [], source
        for k in range(heights):
            t = f"{out}{k + 1}"
            folded = "CASE WHEN u.n > 1 THEN sha256(u.l || x.folded || u.r) ELSE x.folded END AS folded"
            steps.append(f"{t} AS (SELECT x.* REPLACE (x.proof || u.l || u.r AS proof, {folded}) FROM {last} x JOIN {name}{k} u ON {where.format(k=arity**k)})")
            last = t
        return ",\n".join(steps)

    return f"""
WITH a AS (SELECT doc_id, coalesce(':' || lang, '-') AS tree, {leaf("text")} AS leaf, CASE WHEN ({crc32}) % 3 = 0 THEN {leaf(small)} END AS changed FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM a),
o AS (SELECT tree, i, leaf AS d FROM b),
{tree("t", "o")},
q AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d, tree AS lang_tree FROM t{heights}),
{tree("s", "(SELECT tree, i, d FROM q)")},
x AS (SELECT doc_id, tree, i, leaf, '' AS proof, coalesce(changed, leaf) AS folded FROM b),
{climb("t", "x", "y", "u.tree = x.tree AND u.i = x.i // {k}")},
z AS (SELECT y.*, q.i AS place, q.d AS subroot FROM y{heights} y JOIN q ON q.lang_tree = y.tree),
{climb("s", "z", "v", "u.i = x.place // {k}")}
SELECT doc_id, leaf, subroot, s.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = s.d AS verified FROM v{heights} CROSS JOIN s{heights} s"""


def source_mix(weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> str:
    weight = "CASE place % {n} {w} END".format(n=len(weights), w=" ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights)))
    taken = " + ".join(f"greatest(0, least(CAST(floor(target) AS BIGINT) - ({k} * source_size + before), size))" for k in range(most))
    copies = " + ".join(f"CASE WHEN size > 0 AND floor(target) > {k} * source_size + before THEN 1 ELSE 0 END" for k in range(most))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len({SPLIT.format(t="coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, {weight} AS w, {most} * source_size AS most FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s)),
o AS (SELECT *, CAST(sum(source_size) OVER () - (sum(most) OVER (ORDER BY most / w, place) - most) AS BIGINT) AS left_over, CAST(sum(w) OVER (ORDER BY most / w DESC, place DESC) AS BIGINT) AS weights FROM p),
c AS (SELECT *, most * weights < left_over * w AS stopped FROM o),
l AS (SELECT CAST(sum(source_size) - coalesce(sum(most) FILTER (WHERE stopped), 0) AS BIGINT) AS rest, CAST(sum(w) FILTER (WHERE NOT stopped) AS BIGINT) AS w FROM c),
t AS (SELECT source, source_size, CASE WHEN stopped THEN CAST(most AS DOUBLE) ELSE CAST(l.rest AS DOUBLE) * c.w / l.w END AS target FROM c CROSS JOIN l),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY left(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 16), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST({taken} AS BIGINT) AS taken, CAST({copies} AS BIGINT) AS copies FROM b"""
