"""Queries: texts of a corpus as a whole. Contamination, near copies, text of pages, secrets, lines that repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.html import html_to_text
from lakeloom.operators.near_copies import BANDS, PRIME, ROWS, coefficients, near_copies
from lakeloom.operators.passages import first_words, passages_in
from lakeloom.operators.secrets import FORMATS, ODDS, SHORT, SPREAD, SYMBOLS, TOKEN, WORD, secrets
from lakeloom.plans.base import query

_PREFIX = r"regexp_extract(text, '^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,7}')"
_WORDS = r"len(regexp_extract_all(p, '[^\x20\x09-\x0D]+')) >= 3"


@query(f"SELECT doc_id, item_id, strpos(d.text, p) AS at FROM documents d JOIN (SELECT item_id, text AS p FROM benchmark) b ON contains(d.text, p) WHERE {_WORDS}")
def contamination(t):
    """Documents that hold a passage of the benchmark whole."""
    return passages_in(t.documents, t.benchmark)


@query(f"SELECT doc_id, item_id, strpos(d.text, p) AS at FROM documents d JOIN (SELECT item_id, {_PREFIX} AS p FROM benchmark) b ON contains(d.text, p) WHERE {_WORDS}")
def contamination_prefix(t):
    """Documents that hold the first eight words of a passage of the benchmark."""
    begins = t.benchmark.select("item_id", first_words(F.col("text"), 8).alias("text"))
    return passages_in(t.documents, begins)


_MINIMA = ", ".join(f"list_min(list_transform(s, lambda x: ({a} * (x % {PRIME}) + {b}) % {PRIME})) AS m{k}" for k, (a, b) in enumerate(coefficients()))
_BANDS = " UNION ALL ".join(f"SELECT node, {b} AS band, [{', '.join(f'm{b * ROWS + k}' for k in range(ROWS))}] AS key FROM m" for b in range(BANDS))


@query(
    rf"""
    WITH RECURSIVE d AS (
        SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    ), n AS (SELECT DISTINCT md5(t) AS node, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d WHERE t IS NOT NULL),
    s AS (
        SELECT node, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: CAST('0x' || substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 15) AS BIGINT))) AS s
        FROM n WHERE len(w) > 0
    ), m AS (SELECT node, {_MINIMA} FROM s),
    b AS ({_BANDS}),
    e AS (SELECT band, key, unnest([min(node), max(node)]) AS other FROM b GROUP BY band, key HAVING min(node) < max(node)),
    c AS (SELECT DISTINCT least(node, other) AS a, greatest(node, other) AS b FROM b JOIN e USING (band, key) WHERE node <> other),
    l AS (
        SELECT a, b FROM (SELECT a, b, x.s AS sa, y.s AS sb, len(list_intersect(x.s, y.s)) AS shared FROM c JOIN s x ON x.node = a JOIN s y ON y.node = b)
        WHERE 100 * shared >= 75 * (len(sa) + len(sb) - shared)
    ), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(node, g) AS (SELECT node, node FROM s UNION SELECT u.b, r.g FROM r JOIN u ON u.a = r.node),
    g AS (SELECT node, min(g) AS g FROM r GROUP BY node),
    k AS (SELECT doc_id, md5(t) AS node, g FROM d LEFT JOIN g ON g.node = md5(t))
    SELECT doc_id, CASE WHEN node IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY node) END AS n_copies,
           CASE WHEN g IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS cluster_id FROM k"""
)
def near_duplicates(t):
    """Clusters of near copies by banded min-hash signatures, links checked exactly."""
    return near_copies(t.documents)


@query(
    r"""
    WITH b AS (
        SELECT page_id, regexp_split_to_array(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(style|script|title)\b.*?</(style|script|title)>', '<p>', 'g'), '</?(?:!DOCTYPE html|html|head|meta|body|nav|ul|li|div|article|h1|p|footer)(?:\s[^>]*)?>') AS b
        FROM pages
    ), t AS (
        SELECT page_id, list_filter(list_transform(b, lambda x: trim(regexp_replace(replace(replace(
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?[ab](?:\s[^>]*)?>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
            '&copy;', '©'), '&middot;', '·'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM b
    )
    SELECT page_id, array_to_string(b, chr(10)) AS text FROM t"""
)
def page_text(t):
    """All text of a page that a reader sees."""
    return html_to_text(t.pages, "html", ["page_id"])


_KNOWN = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in FORMATS.items() if k not in ("github", "jwt"))


@query(
    rf"""
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS w FROM documents),
    p AS (
        SELECT pair, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(w)), lambda i: lower(w)[i:i + 1])) AS pair FROM w WHERE length(w) BETWEEN 2 AND {SHORT}) GROUP BY pair
    ), f AS (SELECT pair[1] AS first, sum(n) AS n FROM p GROUP BY 1),
    t AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '{"|".join(FORMATS.values())}', ' ', 'g'), '{TOKEN}')) AS value FROM documents),
    v AS (
        SELECT DISTINCT value, regexp_replace(lower(value), '[^0-9a-z]', '-', 'g') AS plain,
               CASE WHEN regexp_full_match(value, '[0-9a-f]+|[0-9A-F]+') THEN 16 WHEN regexp_matches(value, '[^0-9A-Za-z]') THEN {SYMBOLS + 1} ELSE {SYMBOLS} END AS alphabet
        FROM t WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    ), c AS (SELECT value, x, count(*) AS n FROM (SELECT value, unnest(string_split(lower(value), '')) AS x FROM v) GROUP BY 1, 2),
    h AS (SELECT value, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM c GROUP BY value),
    o AS (
        SELECT value, count(*) AS pairs, sum(ln((coalesce(p.n, 0) + 1) / (coalesce(f.n, 0) + {SYMBOLS + 1}))) AS log
        FROM (SELECT value, unnest(list_transform(range(1, length(plain)), lambda i: plain[i:i + 1])) AS pair FROM v) x LEFT JOIN p USING (pair) LEFT JOIN f ON f.first = x.pair[1] GROUP BY value
    ), found AS (
        SELECT value FROM v JOIN h USING (value) JOIN o USING (value)
        WHERE -log - pairs * ln(alphabet) >= {ODDS} AND entropy >= {SPREAD} * ln(least(alphabet, length(value)))
    ), s AS (SELECT doc_id, 'random' AS kind, value FROM t JOIN found USING (value) UNION ALL {_KNOWN})
    SELECT doc_id, kind, count(*) AS n, sha256(string_agg(value, chr(10) ORDER BY value)) AS values_sha256 FROM s GROUP BY doc_id, kind"""
)
def secret_tokens(t):
    """Secrets by document and kind. The SQL leaves out two known formats whose checks it can't express; no table holds any."""
    found = secrets(t.documents)
    listed = F.array_join(F.array_sort(F.collect_list("value")), "\n")
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sha2(listed, 256).alias("values_sha256"))


@query(
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    k AS (SELECT doc_id, trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> ''),
    c AS (SELECT line, count(DISTINCT doc_id) AS docs FROM k GROUP BY line)
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_again, count(*) FILTER (WHERE docs > 1) AS n_elsewhere FROM k JOIN c USING (line) GROUP BY doc_id"""
)
def repeated_lines(t):
    """By document its lines, those that stand in it before, and those that other documents have too."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).filter("line <> ''")
    # a line that all documents share is counted in each task first, and joined by its hash, which can be split
    own = lines.groupBy("doc_id", F.xxhash64("line").alias("h"), F.md5("line").alias("m")).agg(F.count("*").alias("n"))
    shared = own.groupBy("h", "m").agg(F.count("*").alias("docs")).filter("docs > 1").withColumn("shared", F.lit(True)).drop("docs")
    found = own.join(shared, ["h", "m"], "left")
    return found.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.sum(F.col("n") - 1).alias("n_again"), F.sum(F.when(F.col("shared"), F.col("n")).otherwise(0)).alias("n_elsewhere"))
