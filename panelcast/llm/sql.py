"""SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from panelcast.llm import licenses

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "lines": "n_dup_lines * 10 > n_words",
}

HOST_RULES = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
tri AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w),
grams AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM tri),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS j FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM w),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (
  SELECT doc_id, source, len(w) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
h AS (
  SELECT source, count(*) AS n_docs, {", ".join(f"count(*) FILTER ({x}) AS f_{k}" for k, x in _RULES.items())}
  FROM c GROUP BY source),
p AS (SELECT {", ".join(f"avg(f_{k} / n_docs) AS m_{k}, var_pop(f_{k} / n_docs) AS v_{k}" for k in _RULES)} FROM h),
v AS (
  SELECT source, {" AND ".join(
    f"(CASE WHEN v_{k} > 0 THEN (f_{k} + m_{k} * greatest(m_{k} * (1 - m_{k}) / v_{k} - 1, 0)) / (n_docs + greatest(m_{k} * (1 - m_{k}) / v_{k} - 1, 0)) ELSE m_{k} END) <= 0.5"
    for k in _RULES)} AS host_kept
  FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({_RULES["short"]} OR {_RULES["repeats"]}) AS base_failed,
       NOT ({_RULES["short"]} OR {_RULES["repeats"]}) AND host_kept AS kept
FROM c JOIN v ON c.source IS NOT DISTINCT FROM v.source"""

_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

WINNOWING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+least(len(w), 10)-1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT r, i, n, item_id FROM dw JOIN iw USING (n, g)),
places AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
ids AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(l), 0) AS n_items,
       sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN ids USING (r)"""



def _repeats(window: int) -> str:
    """r, i (place from 1) of the words that a window over them, started in a smaller document, removes."""
    return f"""
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i+{window - 1}], ' ')) AS g
  FROM (SELECT *, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + {window})) AS i
  FROM win JOIN least USING (g) WHERE first_id < doc_id)"""


FM_INDEX = f"""
WITH {_repeats(13)},
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (
  SELECT word.r, count(gone.i) AS n, string_agg(x, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS s
  FROM word LEFT JOIN gone ON word.r = gone.r AND word.i = gone.i GROUP BY word.r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

SUFFIX_ARRAY = f"""
WITH {_repeats(50)}
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) AS n_removed
FROM gone JOIN d USING (r) GROUP BY r, doc_id, len(w)"""

SUFFIX_ARRAY_CUT = f"""
WITH {_repeats(50)},
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (
  SELECT word.r, count(gone.i) AS n, string_agg(x, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS s
  FROM word LEFT JOIN gone ON word.r = gone.r AND word.i = gone.i GROUP BY word.r),
island AS (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM gone),
span AS (SELECT r, min(i) - 1 AS a, max(i) AS b FROM island GROUP BY r, k),
spans AS (SELECT r, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM span GROUP BY r),
first AS (
  SELECT r, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS first_id
  FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       CASE WHEN first_id < doc_id THEN first_id END AS copy_of, coalesce(spans, '') AS spans,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN spans USING (r) LEFT JOIN first USING (r)"""

PREFIX_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+4], ' ')) AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM common JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)),
sym AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, b.v FROM reach r JOIN sym b ON r.v = b.u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(reach.v) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.u = d.doc_id GROUP BY d.doc_id, n"""

COLLOCATIONS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
  FROM documents),
piece AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(p) AS s FROM d)),
run AS (SELECT lang, m, array_to_string(w[i:i+m-1], ' ') AS phrase
        FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM piece, range(1, 6) AS t(m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM run GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
cut AS MATERIALIZED (
  SELECT c.lang, c.phrase, c.m, c.a, k, x.f AS l, y.f AS r, n.n,
         CAST((CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN (SELECT * FROM f WHERE f >= 100) x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN (SELECT * FROM f WHERE f >= 100) y ON y.lang = c.lang AND y.phrase = array_to_string(w[k+1:], ' ')
  JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i+s-1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, m, s, unnest(range(1, m - s + 2)) AS i FROM c, range(2, 5) AS t(s) WHERE s < m) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ i ON i.lang = best.lang AND i.phrase = best.phrase WHERE i.most IS NULL OR 100 * i.most < 100 * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000"""

_TEMPLATES = ", ".join(f"({k}, '{t.label}', {t.exact}, '{t.text}')" for k, t in enumerate(licenses.TEMPLATES))

LICENSES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
t AS (SELECT k, label, exact, {_ITEM_WORDS} AS w FROM (VALUES {_TEMPLATES}) AS v(k, label, exact, text)),
tg AS (SELECT k, i, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM t)),
dg AS (SELECT r, i, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
vote AS (SELECT r, k, dg.i - tg.i AS diagonal, tg.i AS p FROM dg JOIN tg USING (g)),
step AS (
  SELECT v.*, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, k ORDER BY diagonal, p) <= CASE WHEN exact THEN 0 ELSE {licenses.SLACK} END
         THEN 0 ELSE 1 END AS new
  FROM vote v JOIN t USING (k)),
chain AS (SELECT *, sum(new) OVER (PARTITION BY r, k ORDER BY diagonal, p) AS c FROM step),
cover AS (SELECT r, k, c, min(diagonal) AS start, count(DISTINCT j) AS n FROM (SELECT *, unnest([p, p + 1, p + 2]) AS j FROM chain) GROUP BY r, k, c),
span AS (SELECT r, start, label, exact, n, len(w) AS size FROM cover JOIN t USING (k) WHERE NOT exact OR n = len(w)),
doc AS (
  SELECT r, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (exact OR n >= {licenses.SHARE} * size)), ',') AS labels,
         max(CASE WHEN exact THEN 1.0 ELSE CAST(n AS DOUBLE) / size END) AS score
  FROM span GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN doc USING (r)"""

ORACLE: dict[str, str] = {"op3_fm_index": FM_INDEX, "op5_suffix_array": SUFFIX_ARRAY, "op5_suffix_array_cut": SUFFIX_ARRAY_CUT, "op4_host_rules": HOST_RULES, "op6_winnowing": WINNOWING, "op10_prefix_join": PREFIX_JOIN, "op11_collocations": COLLOCATIONS, "op12_licenses": LICENSES}
