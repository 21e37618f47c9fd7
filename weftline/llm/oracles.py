"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from . import embeddings, quality, substrings, suffixes

_TRIMMED = r"regexp_replace(coalesce(text, ''), '^[ \t-\r]+|[ \t-\r]+$', '', 'g')"
_WORDS = rf"CASE WHEN {_TRIMMED} = '' THEN [] ELSE string_split_regex({_TRIMMED}, '[ \t-\r]+') END"

EMBEDDINGS = f"""WITH RECURSIVE sound AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {embeddings.COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id"""

_W = suffixes.WINDOW
SUFFIXES = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(generate_series(0, length(h) // 2 - {_W})) AS i, h FROM d),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * _W}) AS s FROM w),
f AS (SELECT s, min(doc_id) AS m FROM k GROUP BY s),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {_W - 1})) AS p FROM k JOIN f USING (s) WHERE doc_id > m),
r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (q IS NULL OR q < p - 1) AS spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM x) GROUP BY doc_id),
b AS (SELECT doc_id, unnest(generate_series(0, length(h) // 2 - 1)) AS p, h FROM d),
kept AS (SELECT b.doc_id, string_agg(substr(h, 2 * p + 1, 2), '' ORDER BY p) AS h FROM b ANTI JOIN x ON x.doc_id = b.doc_id AND x.p = b.p GROUP BY b.doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(r.n, 0) AS n_removed, coalesce(r.spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_N = substrings.WINDOW
SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT doc_id, i, list_slice(w, i, i + {_N - 1}) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {_N - 1})) AS i FROM d)),
f AS (SELECT s, min((doc_id, i)) AS m FROM k GROUP BY s),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {_N - 1})) AS p FROM k JOIN f USING (s) WHERE (doc_id, i) > m),
b AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS t FROM d),
kept AS (SELECT b.doc_id, string_agg(t, ' ' ORDER BY p) AS t, count(*) AS n FROM b ANTI JOIN x ON x.doc_id = b.doc_id AND x.p = b.p GROUP BY b.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _distance(p: str, q: str) -> str:
    a, b = f"{p}[i] / nullif(list_sum({p}), 0)", f"{q}[i] / nullif(list_sum({q}), 0)"
    term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({a} + {b})) ELSE 0 END"
    return f"coalesce(sqrt(greatest(list_sum(list_transform(generate_series(1, len({p})), lambda i: ({term(a)} + {term(b)}) / 2)), 0)), 0)"


def _only(chars: str) -> str:
    return f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"


def _sums(condition: str) -> str:
    columns = ", ".join(f"[{', '.join(f'sum({c}[{i + 1}]) FILTER ({condition})' for i in range(n))}] AS r{c}" for c, n in (("c", len(quality.CLASSES)), ("m", len(quality.COMMON[""]) + 1)))
    return f"SELECT g, {columns} FROM {{}} GROUP BY g"


_LISTED = [x for x in quality.COMMON if x]
QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(f"'{x}'" for x in _LISTED)}) THEN lang ELSE '' END AS g, {_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM d),
tri AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN (SELECT doc_id, s FROM tri GROUP BY ALL HAVING count(*) > 1) USING (doc_id, s)) GROUP BY doc_id),
n AS (SELECT d.doc_id, g, w, len(w) AS n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS word_chars, {_only('#*$%&|<>')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(t) AS total,
    [{_only(r' \t-\r')}, {_only('A-Z')}, {_only('0-9')}, {_only('#*$%&|<>')}, {_only('.,')}, {_only('!')}, strlen(regexp_replace(t, '[ \t-\r]', '', 'g')) - length(regexp_replace(t, '[ \t-\r]', '', 'g'))] AS c7,
    CASE g {' '.join(f"WHEN '{x}' THEN {_list(quality.COMMON[x])}" for x in _LISTED)} ELSE {_list(quality.COMMON[''])} END AS common
    FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
h AS (SELECT *, list_append(c7, greatest(total - list_sum(c7), 0)) AS c, list_transform(common, lambda x: len(list_filter(w, lambda y: y = x))) AS m0, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n),
v AS (SELECT * EXCLUDE (w, c7, common, m0), list_append(m0, greatest(n_words - list_sum(m0), 0)) AS m FROM h),
r1 AS ({_sums('NOT base_failed').format('v')}),
v1 AS (SELECT v.*, {_distance('c', 'rc')} AS cd, {_distance('m', 'rm')} AS wd FROM v JOIN r1 USING (g)),
r2 AS ({_sums(f'NOT base_failed AND cd <= {quality.FIRST_CLASS_DISTANCE} AND wd <= {quality.FIRST_WORD_DISTANCE}').format('v1')}),
v2 AS (SELECT v.*, {_distance('c', 'rc')} AS cd, {_distance('m', 'rm')} AS wd FROM v JOIN r2 USING (g))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (cd > {quality.MAX_CLASS_DISTANCE} AND (total >= {quality.MIN_CHARS_ALONE} OR total >= {quality.MIN_CHARS} AND wd > {quality.MAX_WORD_DISTANCE})) AS kept FROM v2"""

ORACLES = {"op4_embeddings": EMBEDDINGS, "op5_suffixes": SUFFIXES, "op7_substrings": SUBSTRINGS, "op9_quality": QUALITY}
