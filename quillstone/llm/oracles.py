"""SQL of the operators that SQL can express, for DuckDB over the same tables. Written apart from the DataFrame code."""

from __future__ import annotations

from . import decontamination as D
from . import license_scan as L
from . import secret_scan as S

WORDS = r"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def licenses() -> str:
    grams = L.template_grams(L.all_templates())
    rows = ", ".join(f"({t}, '{label}', {str(base).lower()}, {j}, '{w1}', '{w2}', {votes})" for t, label, base, j, w1, w2, votes, _ in grams)
    return f"""
WITH tmpl(t, label, base, j, w1, w2, votes) AS (VALUES {rows}),
d AS (SELECT doc_id, {WORDS.format(c="text")} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
m AS (SELECT DISTINCT doc_id, t, label, base, votes, pos - j AS diagonal, j, pos FROM g JOIN tmpl ON a = w1 AND b = w2),
diag AS (SELECT doc_id, t, base, diagonal, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS step FROM (SELECT DISTINCT doc_id, t, base, diagonal FROM m)),
runs AS (SELECT doc_id, t, diagonal, sum(CASE WHEN step <= CASE WHEN base THEN 0 ELSE {L.MERGE_GAP} END THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS run FROM diag),
place AS (SELECT m.doc_id, m.t, run, j, any_value(label) AS label, any_value(base) AS base, any_value(votes) AS votes, min(m.diagonal) AS start, min(pos) AS lo, max(pos) AS hi FROM m JOIN runs r ON r.doc_id = m.doc_id AND r.t = m.t AND r.diagonal = m.diagonal GROUP BY m.doc_id, m.t, run, j),
points AS (SELECT m.doc_id, m.t, run, list([pos] ORDER BY j, pos DESC) AS ps FROM m JOIN runs r ON r.doc_id = m.doc_id AND r.t = m.t AND r.diagonal = m.diagonal GROUP BY m.doc_id, m.t, run),
chain AS (SELECT doc_id, t, run, len(list_reduce(ps, lambda a, x: a[1:len(list_filter(a, lambda v: v < x[1]))] || x || a[len(list_filter(a, lambda v: v < x[1])) + 2:])) AS longest FROM points),
found AS (SELECT doc_id, any_value(label) AS label, any_value(base) AS base, any_value(votes) AS votes, min(start) AS start, min(lo) AS lo, max(hi) AS hi, any_value(longest) / any_value(votes) AS cover FROM place JOIN chain USING (doc_id, t, run) GROUP BY doc_id, t, run),
kept AS (SELECT * FROM found WHERE cover >= CASE WHEN base OR votes <= {L.SHORT_NOTICE} THEN 1.0 ELSE {L.COVERAGE} END),
s AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(cover) AS score, array_to_string(list_transform(list_sort(list_distinct(list({{'a': lo, 'b': hi, 'c': label}}))), lambda x: x.c || ':' || x.a || ':' || (x.b + 2)), ',') AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)"""


def substrings() -> str:
    return r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(w[s + 1:s + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
least_ AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM win JOIN least_ USING (h), range(0, 50) r(o) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
kept AS (SELECT e.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS k FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def secrets() -> str:
    any_case = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    assign = S.ASSIGN.replace("(?i:(password|passwd|secret|token|api_?key))", "(" + "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")")
    parts = []
    for k, (name, pattern, group, least, _) in enumerate(S.KINDS):
        p = (assign if name == "assign" else pattern).replace("'", "''")
        parts.append(f"SELECT doc_id, source, {k} AS kind, '{name}' AS name, unnest(range(1, n + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(p[1:n]) AS p, {least} AS least FROM (SELECT *, len(m) AS n FROM (SELECT doc_id, source, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v, regexp_split_to_array(text, '{p}') AS p FROM d)) WHERE n > 0")
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
sp AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e, length(v) >= least AS kept FROM raw),
own AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT (source, doc_id)) AS repos FROM sp WHERE kept GROUP BY v),
f AS (SELECT sp.*, e - length(m) AS s, coalesce(owners <= {S.MAX_OWNERS} AND repos <= {S.MAX_REPOS} * owners AND len(list_distinct(string_split(sp.v, ''))) >= {S.MIN_DISTINCT}, false) AS live FROM sp LEFT JOIN own USING (v)),
r AS (SELECT *, name || ':' || s::BIGINT || ':' || e::BIGINT AS said, kept AND (kind < {S.BASE_KINDS} OR live OR name = 'pem') AS shown FROM f),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kept AND kind = {k}) AS n_{S.KINDS[k][0]}" for k in range(S.BASE_KINDS))}, string_agg(said, ',' ORDER BY s, kind) FILTER (kept AND kind < {S.BASE_KINDS}) AS base, string_agg(said, ',' ORDER BY s, kind) FILTER (shown) AS spans, count(*) FILTER (shown AND live) AS n_live, count(*) FILTER (shown AND NOT live) AS n_example FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN a USING (doc_id)"""


def contamination() -> str:
    return f"""
WITH d AS (SELECT doc_id, {WORDS.format(c="text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {WORDS.format(c="text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1:s + least(len(w), 10)], ' ') AS q FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') AS q FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.q = bw.q AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS items FROM hit GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
df AS (SELECT word, count(*) AS df FROM words GROUP BY word),
win AS (SELECT item_id, w, s, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM (SELECT DISTINCT * FROM b) WHERE len(w) > 0)),
each AS (SELECT *, w[o + 1] AS word FROM (SELECT *, unnest(range(s, s + n)) AS o FROM win)),
anc AS (SELECT e.*, least(n, {D.AGREE}) AS needed FROM each e LEFT JOIN df USING (word) QUALIFY row_number() OVER (PARTITION BY item_id, w, s ORDER BY coalesce(df, 0), o) <= {D.NEAR_ANCHORS}),
sh AS (SELECT doc_id, item_id, w AS iw, s, n, needed, o, pos - o AS shift FROM words JOIN anc USING (word)),
met AS (SELECT *, CASE WHEN max(o) OVER f > min(o) OVER f THEN 2 ELSE 1 END AS got FROM sh WINDOW f AS (PARTITION BY doc_id, item_id, iw, s ORDER BY shift RANGE BETWEEN CURRENT ROW AND {D.SLOP} FOLLOWING)),
cand AS (SELECT DISTINCT doc_id, item_id, iw[s + 1:s + n] AS own, shift + s AS start, n FROM met WHERE got >= needed),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM cand JOIN d USING (doc_id) WHERE len(list_intersect(list_distinct(own), w[greatest(start - {D.SLOP}, 0) + 1:greatest(start + n + {D.SLOP}, 0)])) >= {D.NEAR} * len(list_distinct(own)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)"""


def lexical() -> str:
    terms = WORDS.format(c="text").replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS doc, {terms} AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
size AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, size GROUP BY term),
s AS (SELECT item_id, doc, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM p JOIN weight USING (term) JOIN b USING (term), size GROUP BY item_id, doc),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, doc) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10"""


def jaccard() -> str:
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 100 * i >= 80 * (sa.n + sb.n - i)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r),
least_ AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN size USING (doc_id) JOIN least_ USING (doc_id)"""
