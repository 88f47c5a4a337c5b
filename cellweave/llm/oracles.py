"""DuckDB SQL for the queries that it can express in full: chats, the similarity join, URL filters, benchmark leaks, vector codes, clusters."""

from __future__ import annotations

from .chat import Template
from .urlfilter import ENTITIES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chat_sql() -> str:
    """Digests of conversations. A control string in a text costs one character more, and turns are valid if they read s?(ua)+."""
    t = Template()
    pattern = "|".join("".join("\\" + c if not c.isalnum() else c for c in m) for m in ["\\", "]", *t.controls])
    longer = lambda c: f"LENGTH(REGEXP_REPLACE({c}, {_quote(f'({pattern})')}, '\\1x', 'g'))"
    marks = " ".join(f"WHEN {_quote(role)} THEN {len(head) + len(tail)}" for role, (head, tail) in t.marks.items())
    other = f"{sum(map(len, t.other))} + {longer('role')}"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH r AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    x AS (SELECT *, CASE role {marks} ELSE {other} END + {longer('text')} AS formatted FROM r)
    SELECT conv_id, COUNT(*) AS n_turns, SHA256(STRING_AGG(role || CHR(10) || text || CHR(10), '' {order})) AS turns_sha256,
    CAST(SUM(CASE WHEN role = 'assistant' THEN LENGTH(text) ELSE 0 END) AS BIGINT) AS loss_chars, SHA256(STRING_AGG(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' {order})) AS loss_sha256,
    CAST(SUM(formatted) AS BIGINT) AS formatted_chars,
    REGEXP_FULL_MATCH(STRING_AGG(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' {order}), 's?(ua)+') AS valid FROM x GROUP BY 1"""


def jaccard_sql(k: int = 3, num: int = 90, den: int = 100) -> str:
    """Sets of shingles, all pairs that share one, and components of the links."""
    gram = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, LIST_FILTER(STRING_SPLIT_REGEX(TRANSLATE(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), LAMBDA e: e <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, UNNEST(CASE WHEN LEN(w) = 0 THEN [] WHEN LEN(w) < {k} THEN [ARRAY_TO_STRING(w, ' ')] ELSE [{gram} FOR i IN RANGE(1, LEN(w) - {k - 2})] END) AS g FROM w)),
    n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {den} * k >= {num} * (a.n + b.n - k)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    c(id, label) USING KEY (id) AS (SELECT DISTINCT x AS id, x AS label FROM e UNION SELECT m.id, m.label FROM (SELECT e.y AS id, MIN(c.label) AS label FROM c JOIN e ON e.x = c.id GROUP BY 1) m JOIN recurring.c AS r ON r.id = m.id WHERE m.label < r.label)
    SELECT w.doc_id, COALESCE(n, 0) AS n_shingles, COALESCE(label, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id"""


def url_sql(rules: list[tuple[str, str, str]]) -> str:
    """Rules, and verdicts over canonical links and refreshes. Of dot segments, four that lead up are resolved."""
    host = lambda u: f"COALESCE(TRANSLATE(REGEXP_EXTRACT({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"
    path = lambda u: f"COALESCE(REGEXP_EXTRACT({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"

    def own(h: str, p: str, verdict: bool) -> str:
        order = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow"), reverse=True)
        return "CASE " + " ".join(f"WHEN ({h} = {_quote(a)} OR ENDS_WITH({h}, {_quote('.' + a)})) AND STARTS_WITH({p}, {_quote(b)}) THEN {_quote(v if verdict else a + b)}" for v, a, b in order) + " END"

    def plain(p: str) -> str:
        """A path without dot segments; the empty one is /."""
        out = f"REGEXP_REPLACE(REGEXP_REPLACE({p}, '/\\.(/\\.)*/', '/', 'g'), '/\\.$', '/')"
        for _ in range(4):
            out = f"REGEXP_REPLACE(REGEXP_REPLACE({out}, '^(/\\.\\.)+(/|$)', '/'), '/[^/]+/\\.\\.(/|$)', '/')"
        return f"CASE WHEN {p} = '' THEN '/' WHEN {p} LIKE '/%' AND {p} LIKE '%/.%' THEN {out} ELSE {p} END"

    node = lambda u: f"CASE WHEN {u} LIKE '%://%' THEN REGEXP_REPLACE({host(u)}, ':(80|443)$', '') || ({plain(path(u))}) || REGEXP_EXTRACT({u}, '(?s)^[^?#]*(\\?[^#]*)', 1) END"

    def attribute(name: str) -> str:
        head = f"(?is)[\\s\"''/]{name}\\s*=\\s*"
        values = [f"NULLIF(REGEXP_EXTRACT(tag, '{head}{q}\\s*([^{q}>]*?)\\s*{q}', 1), '')" for q in ('"', "''")]
        return f"COALESCE({', '.join(values)}, REGEXP_EXTRACT(tag, '{head}([^\"''\\s>]+)', 1))"

    url = "REGEXP_EXTRACT(tag, '(?is)[\\s\"''/]content\\s*=\\s*[\"'']?[^\"''>]*?\\burl\\s*=\\s*[\"'']?\\s*([^\"''\\s>]*)', 1)"
    to = f"CASE WHEN REGEXP_MATCHES(tag, '(?is)^<link\\b.*\\brel\\s*=\\s*[\"'']?\\s*canonical') THEN {attribute('href')} WHEN REGEXP_MATCHES(tag, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*[\"'']?\\s*refresh') THEN {url} END"
    for sign, char in ENTITIES:
        to = f"REPLACE({to}, {_quote(sign)}, {_quote(char)})"
    site = "REGEXP_EXTRACT(url, '(?s)^(.*?://[^/?#]*)', 1)"
    folder = f"CASE WHEN {path('url')} = '' THEN '/' ELSE REGEXP_EXTRACT({path('url')}, '(?s)^(.*/)', 1) END"
    full = f"CASE WHEN REGEXP_MATCHES(ref, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN ref WHEN REGEXP_MATCHES(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') OR COALESCE(url, '') NOT LIKE '%://%' THEN NULL WHEN ref LIKE '//%' THEN REGEXP_EXTRACT(url, '(?s)^(.*?)://', 1) || ':' || ref WHEN ref LIKE '/%' THEN {site} || ref WHEN ref LIKE '?%' THEN {site} || {path('url')} || ref WHEN ref LIKE '#%' THEN url ELSE {site} || ({folder}) || ref END"
    return f"""WITH RECURSIVE g AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages),
    o AS (SELECT *, {own('host', 'path', False)} AS rule, {own('host', 'path', True)} AS ruled FROM g),
    t AS (SELECT url, UNNEST(REGEXP_EXTRACT_ALL(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE REGEXP_MATCHES(html, '(?i)canonical|http-equiv')),
    f AS (SELECT url, {to} AS ref FROM t), u AS (SELECT url, {full} AS target FROM f WHERE ref <> ''),
    h AS (SELECT {node('url')} AS x, {node('target')} AS y, target FROM u), l AS (SELECT * FROM h WHERE x IS NOT NULL AND y IS NOT NULL),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    c(id, label) USING KEY (id) AS (SELECT DISTINCT x AS id, x AS label FROM e UNION SELECT m.id, m.label FROM (SELECT e.y AS id, MIN(c.label) AS label FROM c JOIN e ON e.x = c.id GROUP BY 1) m JOIN recurring.c AS r ON r.id = m.id WHERE m.label < r.label),
    v AS (SELECT node AS id, ruled FROM o WHERE node IS NOT NULL UNION ALL SELECT y, {own(host('target'), path('target'), True)} FROM l),
    d AS (SELECT label, MIN(ruled) AS least, MAX(ruled) AS most FROM c JOIN v USING (id) WHERE ruled IS NOT NULL GROUP BY 1)
    SELECT page_id, host, path, rule, COALESCE(ruled, CASE WHEN least = 'block' THEN 'block' END, 'allow') AS verdict FROM o LEFT JOIN c ON c.id = o.node LEFT JOIN d ON d.label = c.label"""


def leak_sql(words: int = 10) -> str:
    """Windows of items met with windows of documents of the same numbers of words."""
    found = lambda t: f"REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE({t}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH b AS (SELECT item_id, {found('text')} AS w FROM benchmark), i AS (SELECT item_id, w, LEAST(LEN(w), {words}) AS k FROM b WHERE LEN(w) > 0),
    g AS (SELECT DISTINCT item_id, k, ARRAY_TO_STRING(w[p : p + k - 1], ' ') AS g FROM (SELECT *, UNNEST(RANGE(1, LEN(w) - k + 2)) AS p FROM i)),
    d AS (SELECT ROW_NUMBER() OVER () AS n, doc_id, {found('text')} AS w FROM documents), s AS (SELECT DISTINCT k FROM g),
    o AS (SELECT n, k, p, ARRAY_TO_STRING(w[p : p + k - 1], ' ') AS g FROM (SELECT n, w, k, UNNEST(RANGE(1, LEN(w) - k + 2)) AS p FROM d, s)),
    h AS (SELECT n, p, o.k, item_id FROM o JOIN g ON o.g = g.g AND o.k = g.k),
    x AS (SELECT n, COUNT(DISTINCT p + q) AS hit FROM (SELECT n, p, UNNEST(RANGE(k)) AS q FROM h) GROUP BY 1),
    y AS (SELECT n, COUNT(*) AS items, STRING_AGG(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
    SELECT doc_id, LEN(w) AS n_words, COALESCE(hit, 0) AS n_hit, COALESCE(items, 0) AS n_items, SHA256(COALESCE(said, '')) AS items_sha256, hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN x ON x.n = d.n LEFT JOIN y ON y.n = d.n"""


def _vectors_sql() -> str:
    return "SELECT *, LIST_TRANSFORM(embedding, LAMBDA e: CAST(FLOOR(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND LEN(LIST_FILTER(embedding, LAMBDA e: e IS NULL OR NOT ISFINITE(e))) = 0"


def _distance(a: str, b: str, size: int) -> str:
    return " + ".join(f"({a}[{j}] - {b}[{j}]) * ({a}[{j}] - {b}[{j}])" for j in range(1, size + 1))


def _means(v: str, size: int) -> str:
    """Means of components, rounded down."""
    return "[" + ", ".join(f"CAST((SUM({v}[{j}]) - ((SUM({v}[{j}]) % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*) AS BIGINT)" for j in range(1, size + 1)) + "]"


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, size: int = 16) -> str:
    """Nearest entries by MIN(distance * entries + number), rounds one after the other."""
    out = [f"k AS MATERIALIZED ({_vectors_sql()})", f"p AS MATERIALIZED (SELECT vec_id, label, part, v[part * {size} + 1 : part * {size} + {size}] AS w FROM k, (SELECT UNNEST(RANGE({parts})) AS part))"]
    out.append(f"b0 AS MATERIALIZED (SELECT part, e, w AS c FROM p JOIN (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id))")
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT p.vec_id, p.label, p.part, p.w, MIN(({_distance('p.w', 'b.c', size)}) * {entries} + b.e) AS m FROM p JOIN b{r} b ON b.part = p.part GROUP BY ALL)")
        if r < rounds:
            out.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, COALESCE(u.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT part, m % {entries} AS e, {_means('w', size)} AS c FROM a{r} GROUP BY 1, 2) u ON u.part = b.part AND u.e = b.e)")
    return f"""WITH {', '.join(out)}, o AS (SELECT vec_id, label, STRING_AGG(PRINTF('%02x', m % {entries}), '' ORDER BY part) AS code, CAST(SUM(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY 1, 2)
    SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT SHA256(STRING_AGG(ARRAY_TO_STRING(c, ','), ',' ORDER BY part, e)) FROM b{rounds}) AS codebooks_sha256 FROM o"""


def clusters_sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """Nearest centroids by MIN(distance * k + number), rounds one after the other."""
    out = [f"v AS MATERIALIZED (SELECT vec_id, v AS w FROM ({_vectors_sql()}) WHERE LEN(v) = {dims})"]
    out.append(f"b0 AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY h) - 1 AS e, w AS c FROM (SELECT SHA256('{seed}:' || vec_id) AS h, w FROM v ORDER BY h LIMIT {k}))")
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT v.vec_id, v.w, MIN(({_distance('v.w', 'b.c', dims)}) * {k} + b.e) AS m FROM v, b{r} b GROUP BY ALL)")
        if r < rounds:
            out.append(f"b{r + 1} AS MATERIALIZED (SELECT b.e, COALESCE(u.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT m % {k} AS e, {_means('w', dims)} AS c FROM a{r} GROUP BY 1) u ON u.e = b.e)")
    return f"""WITH {', '.join(out)} SELECT vec_id, CAST(m % {k} AS INT) AS cluster, CAST(m // {k} AS BIGINT) AS distance, CAST(SUM(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia,
    CAST(SUM(m // {k}) OVER () AS BIGINT) AS inertia, SHA256(ARRAY_TO_STRING(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN b{rounds} b ON b.e = m % {k}"""
