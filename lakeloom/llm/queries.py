"""The queries of this subpackage, by name: thin readers of an operator's output over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import id_bucket, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.chat_format import format_conversations, read_back

    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_conversations(rows.union(own)))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.exact_topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.ngram_join import join

    return join(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.media import PAD, sniff_column, store

    stored = store(table(spark, sf_dir, "documents"))
    found = sniff_column(stored, keep=("doc_id", "n_bytes"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(samples, -{PAD})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.col("type").alias("media_type"),
        F.size("embedded").alias("n_embedded"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 3) == 1
    return identify(docs.withColumn("held_out", held_out), fit(docs.filter(~held_out)), keep=("doc_id", "held_out"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.quality import classify, fit

    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.byte_bpe import encode

    found = encode(table(spark, sf_dir, "documents"), decode=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.pii import digests, find

    return digests(find(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    found = score(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.site_tree import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.lexical import build, search

    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_chat_format, op2_exact_topk, op3_ngram_jaccard_join, op4_media_columns, op5_best_fit_packing, op6_language_id, op7_quality_classifier, op8_byte_bpe, op9_pii, op10_toxicity, op11_html_extraction, op12_hard_negatives, op13_lexical_search)}
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(a, b, c, d)
        ), e AS (
            -- each backslash, end mark and # that two more follow has a backslash before it; in roles also each colon
            SELECT *, length(x) - length(replace(x, '\', '')) + (length(x) - length(replace(x, '</turn>', ''))) // 7
                      + coalesce(list_sum(list_transform(regexp_extract_all(x, '###+'), lambda r: length(r) - 2)), 0)
                      + length(role) - length(replace(role, ':', '')) AS escapes
            FROM (SELECT *, role || chr(10) || text AS x FROM c)
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('### : </turn>') + 1 + length(role) + length(text) + escapes) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), g AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM w
        ), s AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
        l AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), r(d, m) AS (SELECT doc_id, doc_id FROM g UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.d)
        SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, c.m AS component_id
        FROM g JOIN (SELECT d, min(m) AS m FROM r GROUP BY d) c ON c.d = g.doc_id""",
    "op2_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        ) WHERE rank <= 20""",
    "op11_html_extraction": r"""
        -- on these pages the main text is the article's; its blocks end at <p> and <h1>, other tags stand inside lines
        WITH a AS (
            SELECT page_id, url, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(p|h1)>') AS b FROM pages
        ), t AS (
            SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(
                regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
                '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM a
        )
        SELECT page_id, url, array_to_string(b, chr(10) || chr(10)) AS text, length(array_to_string(b, chr(10) || chr(10))) AS n_chars FROM t""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND score * 100 BETWEEN 30 * positive_score AND 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents WHERE text IS NOT NULL
        ), c AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(len(t)) AS BIGINT) AS l_all FROM d WHERE len(t) > 0),
        p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_all) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
        i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
        s AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all)))) AS BIGINT) AS score
            FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, r, doc_id
        )
        SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
        WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10""",
    "op9_pii": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        texts AS (SELECT DISTINCT t FROM d),
        m AS (
            SELECT t, 'email' AS kind, 0 AS o, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS v,
                   regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS g FROM texts
            UNION ALL SELECT t, 'ip', 1, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), regexp_split_to_array(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM texts
            UNION ALL SELECT t, 'card', 2, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), regexp_split_to_array(t, '[0-9]([\x20-]?[0-9])+') FROM texts
            UNION ALL SELECT t, 'phone', 3, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM texts
        ), p AS (
            SELECT t, kind, o, v[i] AS val, regexp_replace(v[i], '[^0-9]', '', 'g') AS digits,
                   list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS s
            FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM m)
        ), b AS (
            SELECT t, kind, o, val, digits, CAST(s AS BIGINT) AS s, CAST(s + length(val) AS BIGINT) AS e FROM p
            WHERE CASE kind
                WHEN 'email' THEN true
                WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
                WHEN 'ip' THEN len(list_filter(string_split(val, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INTEGER) > 255)) = 0
                ELSE length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
                    CASE WHEN k % 2 = 1 THEN CAST(reverse(digits)[k] AS INTEGER)
                         ELSE 2 * CAST(reverse(digits)[k] AS INTEGER) - 9 * CAST(CAST(reverse(digits)[k] AS INTEGER) > 4 AS INTEGER) END)) % 10 = 0 END
        ), c AS (
            SELECT t, s, e, val, kind || ':' || CASE kind WHEN 'email' THEN lower(val) WHEN 'ip' THEN val ELSE digits END AS entity FROM b
            UNION ALL
            SELECT t, s, e, val, kind || '~' || CASE kind WHEN 'email' THEN lower(split_part(val, '@', -1)) WHEN 'ip' THEN regexp_extract(val, '^[0-9]+\.[0-9]+')
                                                          WHEN 'card' THEN left(digits, 6) ELSE left(digits, 4) END FROM b
        ), ents AS (SELECT DISTINCT t, entity FROM c),
        n_e AS (SELECT entity, count(*) AS n_e FROM ents GROUP BY 1),
        words AS (
            SELECT t, term FROM (SELECT DISTINCT t, unnest(regexp_extract_all(lower(regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '0', 'g')), '[\p{L}\p{N}]+')) AS term FROM texts)
            WHERE regexp_full_match(term, '\p{L}{3,}')
        ), n_t AS (SELECT term, count(*) AS n_t FROM words GROUP BY 1),
        n_et AS (SELECT entity, term, n_e, count(*) AS n_et FROM ents JOIN n_e USING (entity) JOIN words USING (t) WHERE n_e >= 3 GROUP BY 1, 2, 3 HAVING count(*) >= 3),
        near AS (
            SELECT DISTINCT t, entity, unnest(regexp_extract_all(lower(concat_ws(chr(10),
                       CASE WHEN s > 80 THEN regexp_replace(substring(t, s - 79, 80), '^[\p{L}\p{N}]+', '') ELSE substring(t, 1, s) END, val,
                       CASE WHEN e + 80 <= length(t) THEN regexp_replace(substring(t, e + 1, 80), '[\p{L}\p{N}]+$', '') ELSE substring(t, e + 1, 80) END)), '[\p{L}\p{N}]+')) AS term FROM c
        ), told AS (
            SELECT entity, term FROM n_et JOIN n_t USING (term), (SELECT count(*) AS n FROM texts)
            WHERE n_e < n AND log2(n * n_et / (n_e * n_t)) / log2(n / n_e) >= 0.7
              AND n_et * ln(n * n_et / (n_e * n_t)) + CASE WHEN n_t > n_et THEN (n_t - n_et) * ln((1 - n_et / n_t) / (1 - n_e / n)) ELSE 0 END >= -ln(0.0001)
            UNION ALL
            SELECT entity, term FROM near JOIN words USING (t, term) JOIN n_e USING (entity) JOIN n_t USING (term)
            WHERE n_e < 3 AND n_t = n_e GROUP BY entity, term, n_e HAVING count(*) = n_e
        ), marked AS (SELECT DISTINCT t, term FROM ents JOIN told USING (entity)),
        tokens AS (
            SELECT t, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY t ORDER BY i) AS BIGINT) AS e
            FROM (SELECT t, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS word, unnest(g[1:len(v)]) AS gap FROM (
                SELECT t, regexp_extract_all(t, '[\p{L}\p{N}]+') AS v, regexp_split_to_array(t, '[\p{L}\p{N}]+') AS g FROM (SELECT DISTINCT t FROM marked)))
        ), terms AS (
            SELECT t, e - length(word) AS s, e FROM tokens JOIN marked USING (t)
            WHERE lower(word) = term AND regexp_full_match(word, '\p{L}{3,}')
              AND NOT EXISTS (SELECT 1 FROM b WHERE b.t = tokens.t AND b.s < tokens.e AND tokens.e - length(tokens.word) < b.e)
        ), spans AS (SELECT t, kind, o, s, e FROM b UNION ALL SELECT t, 'term', 4, s, e FROM terms),
        by_text AS (
            SELECT t, count(*) FILTER (WHERE o = 0) AS n_email, count(*) FILTER (WHERE o = 1) AS n_ip, count(*) FILTER (WHERE o = 2) AS n_card, count(*) FILTER (WHERE o = 3) AS n_phone,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (WHERE o < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans,
                   count(*) FILTER (WHERE o = 4) AS n_term FROM spans GROUP BY t
        )
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term
        FROM d LEFT JOIN by_text USING (t)""",
}
