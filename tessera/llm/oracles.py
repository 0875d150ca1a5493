"""DuckDB SQL for the queries that plain SQL can express, written from their contracts and not from the operators' plans."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


#: From the contract: kind, pattern, group of the value, its least length. The last kind is the method's own: long tokens of URL-safe or plain base 64.
SECRETS = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("owned", r"[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24),
)
#: Capitals, digits, stops, marks; and frequent function words of English, German, French and Spanish.
SIGNS = (r"[A-Z]", r"[0-9]", r"[.,;:?'\"()-]", r"[#*$%&|<>!@~^_=+\\/{}\[\]`]")
FREQUENT = (
    "the of and to in is that for was with on are as be this der die und den von zu das mit ist nicht ein auf "
    "de la le et les des en un une que dans pour pas par el los las del se por con una su no para es lo"
).split()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NEAR_DEDUP = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS x FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = p.n AND c = q.n AS same FROM k JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON r.m = l.a),
c AS (SELECT d, min(m) AS component_id FROM r GROUP BY 1),
e AS (SELECT a, min(b) AS m FROM l WHERE same GROUP BY 1)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, t.doc_id = component_id AS kept, least(t.doc_id, coalesce(e.m, t.doc_id)) AS class_id
FROM t JOIN c ON c.d = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN e ON e.a = t.doc_id"""

LINES = f"""WITH x AS (SELECT doc_id, string_split({_LOW}, chr(10)) AS x FROM documents),
u AS (SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) AS line FROM x),
l AS (SELECT doc_id, regexp_extract_all(x, {_SPACED}) AS w, row_number() OVER (ORDER BY doc_id, line) AS place FROM u WHERE regexp_matches(x, {_SPACED})),
f AS (SELECT array_to_string(w, ' ') AS whole, w, len(w) AS n, min(place) AS earliest FROM l GROUP BY w),
p AS (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 8),
v AS (SELECT earliest, i, array_to_string(w[1:i - 1] || w[i + 1:n], ' ') AS v FROM p),
gone AS (SELECT a.earliest FROM v a JOIN (SELECT v, i, min(earliest) AS earliest FROM v GROUP BY 1, 2) b ON a.v = b.v AND a.i = b.i AND b.earliest < a.earliest
UNION SELECT greatest(v.earliest, f.earliest) FROM v JOIN f ON v.v = f.whole AND f.n >= 8),
g AS (SELECT l.doc_id, gone.earliest IS NOT NULL AS near, l.place <> f.earliest AS again FROM l JOIN f ON f.w = l.w LEFT JOIN gone ON gone.earliest = f.earliest),
c AS (SELECT doc_id, count(*) AS n_lines, count_if(again AND NOT near) AS n_exact, count_if(near) AS n_near FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_lines - n_exact - n_near, 0)::BIGINT AS n_kept
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id"""

DECONTAMINATION = f"""WITH items AS (SELECT item_id::VARCHAR AS id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark WHERE regexp_matches({_LOW}, {_ALNUM})),
docs AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
iw AS (SELECT id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items),
win AS (SELECT DISTINCT id, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM iw),
dw AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
dwin AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k FROM dw),
found AS (SELECT doc_id, id, dwin.size, i FROM dwin JOIN win ON dwin.k = win.k AND dwin.size = win.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM found) GROUP BY 1),
dword AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM docs WHERE doc_id IN (SELECT doc_id FROM hit)),
iword AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM items),
diagonal AS (SELECT doc_id, id, p - q AS d, p - row_number() OVER (PARTITION BY doc_id, id, p - q ORDER BY p) AS island FROM dword JOIN iword USING (x)),
longest AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, id, d, island, count(*) AS n FROM diagonal GROUP BY ALL) GROUP BY 1)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, coalesce(longest.n, 0)::BIGINT AS longest_match
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN longest USING (doc_id)"""


def _secrets() -> str:
    parts = [
        f"SELECT doc_id, owner, '{kind}' AS kind, {rank} AS rank, {least} AS least, regexp_extract_all(text, {_quoted(p)}, 0) AS w, "
        f"regexp_extract_all(text, {_quoted(p)}, {group}) AS v, string_split_regex(text, {_quoted(p)}) AS g FROM docs"
        for rank, (kind, p, group, least) in enumerate(SECRETS)
    ]
    size = lambda a: f"coalesce(list_sum(list_transform({a}, lambda x: length(x))), 0)"
    shown = "string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, rank)"
    counts = ", ".join(f"count_if(kind = '{k}') AS n_{k}" for k, _, _, _ in SECRETS[:3])
    zeros = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k, _, _, _ in SECRETS[:3])
    return f"""WITH docs AS (SELECT doc_id, source AS owner, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m),
e AS (SELECT doc_id, owner, kind, rank, least, v[i] AS v, ({size("g[1:i]")} + {size("w[1:i - 1]")})::BIGINT AS lo, length(w[i]) AS n FROM i),
each AS (SELECT doc_id, owner, kind, rank, v, lo, lo + n AS hi FROM e WHERE length(v) >= least AND (kind <> 'owned'
OR regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= 10)),
held AS (SELECT v, owner, count(DISTINCT doc_id) AS n FROM each GROUP BY ALL),
owners AS (SELECT v, count(*) AS owners, sum(n) AS repositories FROM held GROUP BY 1),
known AS (SELECT each.*, owners = 1 AND repositories <= 5 AS live, owners >= 3 AS example FROM each JOIN owners USING (v)),
base AS (SELECT * FROM known WHERE kind <> 'owned'),
added AS (SELECT * FROM known k WHERE kind = 'owned' AND live AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = k.doc_id AND b.lo < k.hi AND k.lo < b.hi)),
kept AS (SELECT * FROM base UNION ALL SELECT * FROM added),
b AS (SELECT doc_id, {counts}, {shown} AS base FROM base GROUP BY 1),
k AS (SELECT doc_id, {shown} AS spans, count_if(live) AS n_live, count_if(example) AS n_example FROM kept GROUP BY 1)
SELECT docs.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM docs LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""


def _quality() -> str:
    common = "[" + ", ".join(map(_quoted, FREQUENT)) + "]"
    classes = ", ".join(f"len(regexp_extract_all(text, {_quoted(p)}))" for p in SIGNS)
    spaces = r"len(regexp_extract_all(text, '[\x20\x09-\x0D]'))"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END / 2"
    return f"""WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, lang, text, regexp_extract_all(text, {_SPACED}) AS w, regexp_extract_all(lower(text), {_SPACED}) AS lw, [{spaces}, {classes}] AS seen,
list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_SPACED})) AS lines FROM docs),
k AS (SELECT doc_id, list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) AS k FROM t),
i AS (SELECT doc_id, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM k),
z AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM i),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM z WHERE c > 1) GROUP BY 1),
n AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
(len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(again.n, 0) > 30 * len(w) AS base_failed,
list_concat([length(text) - list_sum(seen)], seen) AS chars,
list_concat([len(list_filter(lw, lambda x: NOT list_contains({common}, x)))], list_transform({common}, lambda c: len(list_filter(lw, lambda x: x = c)))) AS common
FROM t LEFT JOIN again USING (doc_id)),
bins AS (SELECT doc_id, lang, base_failed, 'chars' AS h, unnest(chars)::DOUBLE AS c, generate_subscripts(chars, 1) AS i FROM n
UNION ALL SELECT doc_id, lang, base_failed, 'common', unnest(common)::DOUBLE, generate_subscripts(common, 1) FROM n),
p AS (SELECT *, coalesce(c / nullif(sum(c) OVER (PARTITION BY doc_id, h), 0), 0) AS p FROM bins),
r AS (SELECT lang, h, i, sum(c) AS c FROM bins WHERE NOT base_failed GROUP BY ALL),
q AS (SELECT lang, h, i, coalesce(c / nullif(sum(c) OVER (PARTITION BY lang, h), 0), 0) AS q FROM r),
d AS (SELECT doc_id, p.h, sqrt(greatest(sum({part("p", "q")} + {part("q", "p")}), 0)) AS d FROM p JOIN q ON p.lang IS NOT DISTINCT FROM q.lang AND p.h = q.h AND p.i = q.i GROUP BY ALL),
noise AS (SELECT doc_id, n_words, sum(least(q / 2, 1 / (8 * ln(2) * greatest(n_words, 1)))) AS mean FROM n JOIN q ON n.lang IS NOT DISTINCT FROM q.lang WHERE h = 'common' GROUP BY ALL),
far AS (SELECT doc_id, coalesce(max(d) FILTER (WHERE h = 'chars'), 0) AS cd, coalesce(max(d) FILTER (WHERE h = 'common'), 0) AS wd FROM docs LEFT JOIN d USING (doc_id) GROUP BY 1),
size AS (SELECT lang, count(*) AS r_n FROM n WHERE NOT base_failed GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance, round(wl, 6) AS word_limit,
NOT base_failed AND NOT (n_words >= 50 AND coalesce(r_n, 0) >= 20 AND (cd > 0.3 OR wd > wl)) AS kept
FROM n JOIN far USING (doc_id) LEFT JOIN (SELECT doc_id, sqrt(0.2 * 0.2 + mean + 3 * sqrt(2 * mean / (8 * ln(2) * greatest(n_words, 1)))) AS wl FROM noise) USING (doc_id) LEFT JOIN size ON size.lang IS NOT DISTINCT FROM n.lang"""


ORACLES = {
    "op1_minhash_near_dedup": NEAR_DEDUP,
    "op4_line_dedup": LINES,
    "op6_benchmark_decontamination": DECONTAMINATION,
    "op8_secret_ownership": _secrets(),
    "op9_quality_rules": _quality(),
}
