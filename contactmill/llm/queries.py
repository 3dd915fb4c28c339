"""Registered queries of this subpackage and the SQL that checks them; what SQL cannot express is tested by brute force."""

from __future__ import annotations

from contactmill.llm import (
    byte_bpe, chat, exact_dedup, hadamard, html_content, lang_id, merkle, mixing, rule_quality, set_sketch, spot_sigs,
    token_prefix, warc,
)
from contactmill.llm.common import read

_WS = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def op1_html_content(spark, sf_dir):
    return html_content.extract(read(spark, sf_dir, "pages"))


def op2_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return lang_id.predict(docs, lang_id.fit(docs))


def op3_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(read(spark, sf_dir, "documents"), stored=True)


def op4_exact_duplicates(spark, sf_dir):
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op5_spot_signatures(spark, sf_dir):
    return spot_sigs.edited_fingerprints(read(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return rule_quality.score(docs, rule_quality.fit(docs, read(spark, sf_dir, "labels")))


def op7_token_counts(spark, sf_dir):
    return token_prefix.token_counts(read(spark, sf_dir, "documents"))


def op8_chat_format(spark, sf_dir):
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op9_near_duplicates(spark, sf_dir):
    return set_sketch.near_duplicates(read(spark, sf_dir, "documents"))


def op10_source_mix(spark, sf_dir):
    return mixing.mixed_sizes(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.manifest(read(spark, sf_dir, "documents"))


def op12_warc_captures(spark, sf_dir):
    return warc.archived(read(spark, sf_dir, "pages")).drop("archive", "offset")


def op13_centroid_clusters(spark, sf_dir):
    return hadamard.clusters(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_content": op1_html_content,
    "op2_language": op2_language,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_duplicates": op4_exact_duplicates,
    "op5_spot_signatures": op5_spot_signatures,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_chat_format": op8_chat_format,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_source_mix": op10_source_mix,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_warc_captures": op12_warc_captures,
    "op13_centroid_clusters": op13_centroid_clusters,
}

_FIELDS = " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    for c in ("doc_id", "source", "lang", "n_chars", "{text}")
)
_CRC32 = """list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: list_concat([ord(c)::UBIGINT], list_value(999, 999, 999, 999, 999, 999, 999, 999)::UBIGINT[])))),
    lambda a, b: CASE WHEN b < 999 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END)"""
_SURT_HEAD = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)"


def _rounds_sql(rounds: int) -> str:
    """Assignments and centroids, round by round."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, m.c,
            CAST(list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
            FROM kept v CROSS JOIN c{r} m) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, list(q ORDER BY i) AS x FROM (
                SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
                    FROM (SELECT a.c, unnest(range(1, 65)) AS i, unnest(v.x) AS x FROM a{r} a JOIN kept v USING (vec_id)) GROUP BY c, i))
                GROUP BY c UNION ALL SELECT c, x FROM c{r} WHERE c NOT IN (SELECT c FROM a{r}))""")
    return ", ".join(parts)



ORACLES = {
    "op4_exact_duplicates": f"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY norm)""",
    "op8_chat_format": r"""
        WITH numbered AS (
            SELECT conv_id, role, text, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS n
            FROM conversations WHERE conv_id IS NOT NULL
        ), prefixes AS (
            SELECT *, count(*) OVER (PARTITION BY conv_id) AS n_turns, md5(string_agg(
                coalesce(md5(role), '-') || coalesce(md5(text), '-'), ' ') OVER (PARTITION BY conv_id ORDER BY n)) AS prefix
            FROM numbered
        ), kept AS (
            SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies FROM prefixes AS p
            WHERE n = n_turns AND NOT EXISTS (
                SELECT 1 FROM prefixes AS q WHERE q.n = p.n AND q.prefix = p.prefix AND q.n_turns > q.n)
            GROUP BY n_turns, prefix
        )
        SELECT conv_id, CAST((n - 1) // 256 AS BIGINT) AS part, k.n_turns, n_copies, string_agg(
            '<|im_start|>' || coalesce(role, 'unknown') || chr(10)
            || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1|>', 'g') || '<|im_end|>' || chr(10),
            '' ORDER BY n) AS text
        FROM numbered JOIN kept AS k USING (conv_id) GROUP BY conv_id, part, k.n_turns, n_copies""",
    "op10_source_mix": f"""
        WITH sizes AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents
        ), totals AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   row_number() OVER (ORDER BY source IS NULL, source) AS no FROM sizes GROUP BY source
        ), caps AS (
            SELECT *, CAST(CASE (no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
                   source_size * CAST(2 AS DOUBLE) AS cap, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS wanted FROM totals
        ), before AS (
            SELECT *, coalesce(sum(cap) OVER lower, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER lower, 0) AS free
            FROM caps WINDOW lower AS (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), rate AS (
            SELECT (wanted - capped) / free AS rate FROM before WHERE (wanted - capped) / free <= cap / w ORDER BY cap / w, no LIMIT 1
        ), targets AS (
            SELECT source, source_size, least(cap, w * rate) AS target FROM caps, rate
        ), placed AS (
            SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target) AS quota,
                   coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(CAST(s.doc_id AS VARCHAR)), s.doc_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(greatest(0, least(start + size, quota) - start)
                    + greatest(0, least(source_size + start + size, quota) - source_size - start) AS BIGINT) AS taken
        FROM placed""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE rows AS (
            SELECT doc_id, lang, sha256({_FIELDS.format(text="text")}) AS leaf, {_CRC32} AS c,
                   sha256({_FIELDS.format(text=f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")}) AS changed FROM documents
        ), leaves AS (
            SELECT *, CASE WHEN xor(c, 4294967295) % 3 = 0 THEN changed ELSE leaf END AS tampered,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM rows
        ), tree AS (
            SELECT lang, 0 AS l, p, leaf AS d, n FROM leaves
            UNION ALL
            SELECT lang, l + 1, p // 8, sha256(string_agg(d, '' ORDER BY p)), max((n + 7) // 8) FROM tree WHERE n > 1 GROUP BY lang, l, p // 8
        ), subroots AS (
            SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM tree WHERE n = 1
        ), upper AS (
            SELECT 0 AS l, p, subroot AS d, n FROM subroots
            UNION ALL
            SELECT l + 1, p // 8, sha256(string_agg(d, '' ORDER BY p)), max((n + 7) // 8) FROM upper WHERE n > 1 GROUP BY l, p // 8
        ), nodes AS (
            SELECT lang, l, p, d, n, 0 AS part FROM tree UNION ALL SELECT NULL, l, p, d, n, 1 FROM upper
        ), steps AS (
            SELECT v.doc_id, o.part, o.l, coalesce(string_agg(s.d, '' ORDER BY s.p) FILTER (s.p < o.p), '') AS a,
                   coalesce(string_agg(s.d, '' ORDER BY s.p) FILTER (s.p > o.p), '') AS b
            FROM leaves v JOIN subroots r ON v.lang IS NOT DISTINCT FROM r.lang
            JOIN nodes o ON o.n > 1 AND o.p = (CASE o.part WHEN 0 THEN v.p ELSE r.p END) // CAST(pow(8, o.l) AS BIGINT)
                AND (o.part = 1 OR o.lang IS NOT DISTINCT FROM v.lang)
            JOIN nodes s ON s.part = o.part AND s.l = o.l AND s.lang IS NOT DISTINCT FROM o.lang AND s.p // 8 = o.p // 8
            GROUP BY v.doc_id, o.part, o.l
        ), paths AS (
            SELECT doc_id, list({{'a': a, 'b': b}} ORDER BY part, l) AS path FROM steps GROUP BY doc_id
        ), folded AS (
            SELECT doc_id, 1 AS step, tampered AS d FROM leaves
            UNION ALL
            SELECT f.doc_id, step + 1, sha256(path[step].a || d || path[step].b) FROM folded f JOIN paths p ON f.doc_id = p.doc_id WHERE step <= len(path)
        )
        SELECT v.doc_id, v.leaf, r.subroot, t.d AS root,
               sha256(coalesce(array_to_string(list_transform(p.path, lambda s: s.a || s.b), ''), '')) AS proof_sha256,
               f.d AS folded_root, f.d = t.d AS verified
        FROM leaves v JOIN subroots r ON v.lang IS NOT DISTINCT FROM r.lang JOIN upper t ON t.n = 1
        LEFT JOIN paths p ON p.doc_id = v.doc_id
        JOIN (SELECT doc_id, arg_max(d, step) AS d FROM folded GROUP BY doc_id) f ON f.doc_id = v.doc_id""",
    "op12_warc_captures": f"""
        WITH parts AS (
            SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
                   regexp_replace(coalesce(url, ''), '#.*$', '') AS plain,
                   CAST(TIMESTAMP '2000-01-01' + to_seconds(page_id % 1000000000) AS VARCHAR) AS t FROM pages
        ), keys AS (
            SELECT *, replace(t, ' ', 'T') || 'Z' AS captured, regexp_replace(plain, '{_SURT_HEAD}', '') AS rest,
                   regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(plain, '{_SURT_HEAD}', 1)), '^.*@', ''),
                                                 ':[0-9]*$', ''), '^www[0-9]*\\.', '') AS host FROM parts
        ), named AS (
            SELECT *, CASE WHEN regexp_matches(plain, '{_SURT_HEAD}')
                THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END
                ELSE plain END AS urlkey FROM keys
        )
        SELECT page_id, payload_bytes, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, url, urlkey, captured,
               row_number() OVER (PARTITION BY urlkey ORDER BY captured, page_id) AS capture,
               array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) >> s & 31) + 1, 1)), '')), '')
               AS payload_digest
        FROM named""",
    "op13_centroid_clusters": f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(v::DOUBLE * 256) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT x, sha256('2:' || vec_id) AS h FROM kept ORDER BY h LIMIT 40)
        ), {_rounds_sql(5)}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
        FROM a5 a JOIN c5 m USING (c)""",
}
