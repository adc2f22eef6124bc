"""DuckDB SQL for the queries that SQL can express. Each is written from the contract, not from the operator's plan."""

from __future__ import annotations

from . import license_scan, line_runs, mixing, secret_scan

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i + 1:i + n], ' ') AS s FROM (SELECT item, w, n, unnest(range(len(w) - n + 1)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM sized),
spans AS (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS s FROM (SELECT r, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, lengths)),
hits AS (SELECT r, i, spans.n, item FROM spans JOIN windows ON spans.s = windows.s AND spans.n = windows.n),
per_doc AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_doc USING (r) LEFT JOIN items USING (r)
"""

# All pairs with a common shingle, and all texts that can be reached over links; the operator looks at far fewer.
NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
shingles AS (SELECT r, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT r, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
bags AS (SELECT r, s, count(*) AS n FROM shingles GROUP BY r, s),
sizes AS (SELECT r, sum(n) AS size FROM bags GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, sum(least(a.n, b.n)) AS shared FROM bags a JOIN bags b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
pairs AS (SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 10 * shared >= 8 * (x.size + y.size - shared)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT r AS a, r AS b FROM d UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b)
SELECT x.doc_id, CASE WHEN len(x.w) = 0 THEN x.doc_id ELSE min(y.doc_id) END AS class_id
FROM d x JOIN reached ON reached.a = x.r JOIN d y ON y.r = reached.b GROUP BY x.r, x.doc_id, x.w
"""

# Runs are windows of two lines that aren't blank, or one line of enough words.
LINE_RUNS = f"""
WITH d AS (SELECT DISTINCT doc_id, text, md5(coalesce(doc_id::VARCHAR, '') || ':' || text) AS doc FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM d),
full_lines AS (
    SELECT *, len(list_filter(string_split_regex(line, '[ \\t\\x0B\\f\\r]+'), lambda w: w <> '')) AS words, row_number() OVER (PARTITION BY doc ORDER BY place) AS nth
    FROM lines WHERE NOT regexp_full_match(line, '[ \\t\\x0B\\f\\r]*')
),
runs AS (
    SELECT doc_id, doc, nth, 1 AS n, [line] AS key FROM full_lines WHERE words >= {line_runs.MIN_WORDS}
    UNION ALL
    SELECT a.doc_id, a.doc, a.nth, 2 AS n, [a.line, b.line] AS key FROM full_lines a JOIN full_lines b ON a.doc = b.doc AND b.nth = a.nth + 1
),
later AS (SELECT doc, nth, n FROM (SELECT *, row_number() OVER (PARTITION BY n, key ORDER BY doc_id NULLS FIRST, doc, nth) AS copy FROM runs) WHERE copy > 1),
gone AS (SELECT DISTINCT doc, unnest(range(nth, nth + n)) AS nth FROM later),
kept AS (
    SELECT l.doc, count(*) AS n_lines, count(g.nth) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE g.nth IS NULL), '') AS body
    FROM lines l LEFT JOIN full_lines f ON f.doc = l.doc AND f.place = l.place LEFT JOIN gone g ON g.doc = f.doc AND g.nth = f.nth GROUP BY l.doc
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, length(body)::BIGINT AS kept_chars, md5(body) AS kept_md5
FROM documents LEFT JOIN kept ON kept.doc = md5(coalesce(doc_id::VARCHAR, '') || ':' || text)
"""


def _licenses() -> str:
    rows = []
    for name, text in license_scan.TEMPLATES.items():
        k, reach = license_scan.reach_of(text)
        shingles = license_scan.shingles_of(text)
        rows += [f"('{name}', {k}, {reach}, {len(shingles)}, '{s}')" for s in shingles]
    part, whole = license_scan.CONTAINMENT
    return f"""
WITH t(name, k, reach, size, shingle) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[a-z0-9]+') AS w FROM documents),
spans AS (SELECT r, k, i, array_to_string(w[i + 1:i + k], ' ') AS shingle FROM (SELECT r, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS i FROM d, (SELECT DISTINCT k FROM t))),
placed AS (SELECT r, name, size, shingle, i, k, reach, i // reach - unnest([0, 1]) AS m FROM spans JOIN t USING (k, shingle)),
held AS (SELECT r, name FROM placed WHERE m >= 0 AND i - m * reach < 2 * reach GROUP BY r, name, size, m HAVING count(DISTINCT shingle) * {whole} >= size * {part}),
names AS (SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS licenses FROM (SELECT DISTINCT r, name FROM held) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses FROM d LEFT JOIN names USING (r)
"""


def _secrets() -> str:
    """Positions come from the texts between matches; the entropy of each window is counted afresh."""

    def found(pattern: str, kind: int, keep: str, group: int = 0) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        return f"""SELECT r, {kind} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
            's': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
            'n': length(m[i]), 'v': v[i]}})) AS x FROM (SELECT r, regexp_extract_all(body, {p}) AS m, regexp_extract_all(body, {p}, {group}) AS v, string_split_regex(body, {p}) AS g FROM d)"""

    names = "[" + ", ".join(f"'{k}'" for k in secret_scan.KINDS) + "]"
    sums = "[" + ", ".join(map(str, secret_scan.SUMS)) + "]"
    n, window = "len(c)", secret_scan.WINDOW
    assign = secret_scan.ASSIGN.replace("(?i)(", "((?i:", 1).replace(")(?-i)", "))", 1)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
base AS (
    SELECT r, kind, x.s::BIGINT AS s, (x.s + x.n)::BIGINT AS e FROM ({found(assign, 0, "v", 2)}) WHERE length(x.v) >= {secret_scan.LEAST_VALUE}
    UNION ALL SELECT r, kind, x.s::BIGINT, (x.s + x.n)::BIGINT FROM ({found(secret_scan.ACCESS, 1, "m")})
    UNION ALL SELECT r, kind, x.s::BIGINT, (x.s + x.n)::BIGINT FROM ({found(secret_scan.HEX, 2, "m")})
),
runs AS (SELECT r, x.s::BIGINT AS s, string_split_regex(x.v, '{secret_scan.ALLOWED}') AS p, regexp_extract_all(x.v, '{secret_scan.ALLOWED}') AS m FROM ({found(secret_scan.CANDIDATE, 3, "m")})),
candidates AS (
    SELECT r, s + coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, string_split(p[i], '') AS c
    FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM runs)
),
windows AS (SELECT r, s, i, c[i + 1:i + {window}] AS c FROM (SELECT r, s, c, unnest(range(len(c) - {window} + 1)) AS i FROM candidates)),
measured AS (
    SELECT r, s, i, len(list_filter(c, lambda x: x BETWEEN '0' AND '9')) AS digits, len(list_filter(c, lambda x: regexp_full_match(x, '[0-9a-fA-F]'))) AS hexes,
        list_sum(list_transform(map_values(list_histogram(c)), lambda k: {sums}[k::BIGINT + 1])) AS total FROM windows
),
hot AS (SELECT r, s, i FROM measured WHERE digits < {window} AND CASE WHEN hexes = {window} THEN total <= {secret_scan._most(secret_scan.HEX_BITS)} ELSE digits >= 2 AND total <= {secret_scan._most(secret_scan.WIDE_BITS)} END),
parted AS (SELECT *, sum(CASE WHEN i - before <= {window} THEN 0 ELSE 1 END) OVER (PARTITION BY r, s ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY r, s ORDER BY i) AS before FROM hot)),
entropy AS (SELECT r, 3 AS kind, s + min(i) AS s, s + max(i) + {window} AS e FROM parted GROUP BY r, s, run),
fresh AS (SELECT * FROM entropy x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.s <= x.s AND x.e <= b.e)),
every AS (SELECT *, {names}[kind + 1] || ':' || s || ':' || e AS shown FROM (SELECT r, kind, s, e FROM base UNION ALL SELECT r, kind, s, e FROM fresh)),
joined AS (
    SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
        string_agg(shown, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(shown, ',' ORDER BY s, kind) AS spans FROM every GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (r)
"""


def mixed(weights: dict[str, dict[str, int]], share: tuple[int, int] = (4, 5), epochs: int = 2, seed: int = 17) -> str:
    """The same budget levels as unrolled common tables; leaves' prefixes by plain running sums."""

    def weigh(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.get(level, {}).items())
        return f"(CASE coalesce({level}, '') {cases} ELSE 1 END)" if cases else "1"

    order = "('0x' || substr(md5(identity || ':' || {0}::VARCHAR), 1, 15))::BIGINT"
    levels, parent = [], None
    for depth in range(1, 4):
        keys = list(mixing.TREE[:depth])
        up = keys[:-1]
        purse = f"(SELECT sum(tokens) FROM leaves)::BIGINT * {share[0]} // {share[1]}" if not up else "p.budget"
        same = " AND ".join(f"n.{k} IS NOT DISTINCT FROM p.{k}" for k in up)
        columns = ", ".join(f"n.{k}" for k in keys)
        part = f"PARTITION BY {', '.join(up)}" if up else ""
        levels.append(f"""n{depth} AS (SELECT {columns}, n.capacity, n.weight, {purse} AS purse FROM
            (SELECT {", ".join(keys)}, sum(capacity)::BIGINT AS capacity, any_value({weigh(keys[-1])}) AS weight FROM usable GROUP BY ALL) n {f"JOIN b{depth - 1} p ON {same}" if up else ""}),
        r{depth} AS (SELECT *, CASE WHEN weight > 0 THEN capacity ELSE 0 END AS useful,
            purse - coalesce(sum(CASE WHEN weight > 0 THEN capacity ELSE 0 END) OVER before, 0) AS remaining, sum(weight) OVER after AS rest FROM n{depth}
            WINDOW before AS ({part} ORDER BY CASE WHEN weight > 0 THEN capacity::DOUBLE / weight ELSE 0 END, {keys[-1]} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                after AS ({part} ORDER BY CASE WHEN weight > 0 THEN capacity::DOUBLE / weight ELSE 0 END, {keys[-1]} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        b{depth} AS (SELECT {", ".join(keys)}, CASE WHEN weight > 0 THEN least(useful, floor(max(CASE WHEN weight > 0 THEN greatest(remaining, 0)::DOUBLE / rest::DOUBLE END) OVER ({part}) * weight)::BIGINT) ELSE 0 END AS budget FROM r{depth})""")
        parent = depth
    tree = ", ".join(mixing.TREE)
    return f"""
WITH d AS (
    SELECT doc_id, lang, source AS src, CASE WHEN regexp_extract(coalesce(source, ''), '[0-9]+') = '' THEN 'other' ELSE 'domain' || (right(regexp_extract(source, '[0-9]+'), 9)::BIGINT % 3) END AS domain,
        lang AS language, source, md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS identity,
        len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS tokens FROM documents
),
leaves AS (SELECT {tree}, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
usable AS (SELECT {tree}, CASE WHEN {weigh("domain")} * {weigh("language")} * {weigh("source")} > 0 THEN tokens ELSE 0 END * {epochs} AS capacity FROM leaves),
{", ".join(levels)},
plan AS (SELECT l.domain, l.language, l.source, CASE WHEN l.tokens > 0 THEN budget // l.tokens ELSE 0 END AS whole, CASE WHEN l.tokens > 0 THEN budget % l.tokens ELSE 0 END AS part
    FROM leaves l JOIN b{parent} b ON l.domain IS NOT DISTINCT FROM b.domain AND l.language IS NOT DISTINCT FROM b.language AND l.source IS NOT DISTINCT FROM b.source),
ordered AS (SELECT d.*, p.whole, p.part, {order.format("(p.whole + 1)")} AS place FROM d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.language IS NOT DISTINCT FROM p.language AND d.source IS NOT DISTINCT FROM p.source),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY {tree} ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ordered),
cut AS (SELECT *, min(CASE WHEN part > 0 AND upto >= part THEN place END) OVER (PARTITION BY {tree}) AS last FROM summed)
SELECT doc_id, lang, src AS source, (whole + CASE WHEN place <= last THEN 1 ELSE 0 END)::INT AS copies FROM cut WHERE whole + CASE WHEN place <= last THEN 1 ELSE 0 END > 0
"""


LICENSES = _licenses()
SECRETS = _secrets()
