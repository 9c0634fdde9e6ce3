"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from hyperstrata.llm.licenses import COVER, K, STRETCH, templates
from hyperstrata.llm.line_dedup import DEPTH, MIN_DOCS, RUNS, SIMILARITY

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BLANK = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

def _round(k: int) -> str:
    """The CTEs of one round: untried meetings, the largest of each line, votes, seeds, and the lines that share a template."""
    left = (
        f"SELECT n, leaf, t, w, []::BIGINT[] AS tried FROM kinds JOIN (SELECT n, leaf FROM kinds WHERE floor((1 - {SIMILARITY}) * (n - {DEPTH}) + 1e-9) >= 1 GROUP BY 1, 2 HAVING count(*) > 1) USING (n, leaf)"
        if k == 0
        else f"SELECT n, leaf, t, w, list_append(tried, run) AS tried FROM j{k - 1} LEFT JOIN a{k - 1} USING (n, leaf, run, key) WHERE NOT (joins AND lines IS NOT NULL)"
    )
    runs = f"least({RUNS}, CAST(floor((1 - {SIMILARITY}) * len(w) + 1e-9) AS BIGINT) + 1)"
    return f"""
l{k} AS MATERIALIZED ({left}),
e{k} AS (SELECT n, leaf, t, run, array_to_string(w[run * len(w) // runs + 1 : (run + 1) * len(w) // runs], ' ') AS key FROM (SELECT *, unnest(range(runs)) AS run FROM (SELECT *, {runs} AS runs FROM l{k})) WHERE NOT list_contains(tried, run)),
b{k} AS (SELECT n, leaf, t, run, key FROM (SELECT *, count(*) OVER (PARTITION BY n, leaf, run, key) AS size FROM e{k}) WHERE size > 1 QUALIFY row_number() OVER (PARTITION BY n, leaf, t ORDER BY size DESC, run) = 1),
p{k} AS MATERIALIZED (SELECT * FROM l{k} JOIN b{k} USING (n, leaf, t)),
u{k} AS (SELECT n, leaf, run, key, t, w, unnest(range(len(w))) AS place, unnest(w) AS word FROM p{k}),
c{k} AS (SELECT n, leaf, run, key, place, word FROM u{k} GROUP BY 1, 2, 3, 4, 5, 6 QUALIFY row_number() OVER (PARTITION BY n, leaf, run, key, place ORDER BY count(*) DESC, word DESC) = 1),
s{k} AS (SELECT n, leaf, run, key, w AS seed FROM (SELECT u.n, u.leaf, u.run, u.key, u.t, u.w, count(*) FILTER (WHERE u.word = c.word) AS same FROM u{k} u JOIN c{k} c USING (n, leaf, run, key, place) GROUP BY 1, 2, 3, 4, 5, 6) QUALIFY row_number() OVER (PARTITION BY n, leaf, run, key ORDER BY same DESC, w DESC) = 1),
j{k} AS MATERIALIZED (SELECT n, leaf, run, key, t, w, tried, len(list_filter(range(len(w)), lambda i: w[i + 1] = seed[i + 1])) >= {SIMILARITY} * len(w) AS joins FROM p{k} JOIN s{k} USING (n, leaf, run, key)),
a{k} AS MATERIALIZED (SELECT n, leaf, run, key, count(*) AS lines FROM j{k} WHERE joins GROUP BY 1, 2, 3, 4 HAVING count(*) > 1),"""


LINE_DEDUP = f"""
WITH
l AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, pos, list_transform(string_split(trim(regexp_replace(line, '[ \\x09\\x0B-\\x0D]+', ' ', 'g'), ' '), ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l WHERE trim(line, {BLANK}) <> ''),
m AS (SELECT doc_id, text, pos, w, len(w) AS n, array_to_string(w[1:{DEPTH}], ' ') AS leaf, array_to_string(w, ' ') AS t FROM w),
kinds AS (SELECT n, leaf, t, any_value(w)[{DEPTH + 1}:] AS w FROM m GROUP BY 1, 2, 3),{"".join(map(_round, range(RUNS)))}
merged AS ({" UNION ALL ".join(f"SELECT n, leaf, t, {k} || ' ' || run || ' ' || key AS place FROM j{k} JOIN a{k} USING (n, leaf, run, key) WHERE joins" for k in range(RUNS))}),
g AS (SELECT m.doc_id, m.text, m.pos, CASE WHEN merged.t IS NULL THEN 'line ' || m.t ELSE 'leaf ' || m.n || ' ' || m.leaf || ' ' || merged.place END AS template FROM m LEFT JOIN merged USING (n, leaf, t)),
recurring AS (SELECT template, min(doc_id) AS first FROM (SELECT DISTINCT template, doc_id, text FROM g) GROUP BY 1 HAVING count(*) >= {MIN_DOCS}),
dropped AS (SELECT DISTINCT doc_id, text, pos FROM g JOIN recurring USING (template) WHERE doc_id > first),
kept AS (SELECT l.doc_id, l.text, string_agg(l.line, chr(10) ORDER BY l.pos) AS kept FROM (SELECT DISTINCT * FROM l) l ANTI JOIN dropped USING (doc_id, text, pos) GROUP BY 1, 2),
lines AS (SELECT doc_id, text, count(DISTINCT pos) AS n FROM m GROUP BY 1, 2),
gone AS (SELECT doc_id, text, count(*) AS n FROM dropped GROUP BY 1, 2)
SELECT d.doc_id, CAST(coalesce(lines.n, 0) AS INTEGER) AS n_lines, CAST(coalesce(gone.n, 0) AS INTEGER) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.kept, '') END AS text
FROM documents d LEFT JOIN lines ON lines.doc_id = d.doc_id AND lines.text = d.text LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.text = d.text LEFT JOIN kept ON kept.doc_id = d.doc_id AND kept.text = d.text"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(32), lambda k: substr('{BASE32}', CAST(((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM h"""


def license_scan() -> str:
    rows = []
    for t in templates():
        words = [w.decode() for w in t["words"]]
        for k in range(len(words) - K + 1):
            gram = " ".join(words[k : k + K])
            rows.append(f"({t['template']}, '{t['label']}', {str(t['phrase']).lower()}, {0 if t['phrase'] else 3}, {len(words)}, {len(words) - K + 1}, {k}, '{gram}')")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    labels = lambda which: f"coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE ok{which}))), ','), '')"
    return f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(rows)}) AS t(template, label, phrase, gap, t_words, t_grams, t_place, gram)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT r, unnest(range(len(w) - {K - 1})) AS place, unnest(list_transform(range(len(w) - {K - 1}), lambda k: w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3])) AS gram FROM d WHERE len(w) >= {K}),
v AS (SELECT r, template, label, phrase, gap, t_words, t_grams, place - t_place AS diagonal, list(DISTINCT t_place) AS held, min(place) AS a, max(place) + {K} AS b FROM g JOIN t USING (gram) GROUP BY ALL),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= gap THEN 0 ELSE 1 END AS fresh FROM v),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS island FROM n),
s AS (SELECT r, template, label, phrase, t_words, t_grams, island, len(list_distinct(flatten(list(held)))) AS held, min(a) AS a, max(b) AS b, bool_or(NOT phrase AND len(held) / t_grams >= {COVER} AND b - a <= {STRETCH} * t_words) AS alone FROM i GROUP BY r, template, label, phrase, t_words, t_grams, island),
q AS (SELECT *, held / t_grams AS cover, CASE WHEN phrase THEN held = t_grams ELSE alone OR held / t_grams >= {COVER} AND b - a <= {STRETCH} * t_words END AS ok FROM s),
x AS (SELECT r, max(cover) AS score, count(*) FILTER (WHERE ok AND phrase) AS n_base, min(a) FILTER (WHERE ok AND phrase) AS first_word, max(a) FILTER (WHERE ok AND phrase) AS last_word, {labels(" AND phrase")} AS base_labels, {labels("")} AS labels FROM q GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN x USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINE_DEDUP, "op6_warc": WARC, "op9_license_scan": license_scan()}
