"""DuckDB SQL for the queries of this folder that SQL can express."""

SQL = {
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g USING (norm)
    """,
    "op9_lm_score": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
        p AS (SELECT doc_id, w, i, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM t),
        n AS (SELECT doc_id, len(ws) AS n_words, (SELECT count(*) FROM t) - len(ws) AS rest FROM d),
        c AS (SELECT doc_id, i, w, u,
                count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS cw,
                CASE WHEN u IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY u, w) - count(*) OVER (PARTITION BY doc_id, u, w) END AS cuw
              FROM p),
        h AS (SELECT *, lag(cw) OVER (PARTITION BY doc_id ORDER BY i) AS cu FROM c),
        s AS (SELECT doc_id, sum(ln(CASE WHEN cuw > 0 THEN cuw / cu WHEN cw > 0 THEN 0.4::DOUBLE * cw / greatest(rest, 1) ELSE 0.4::DOUBLE * 0.4::DOUBLE / greatest(rest, 1) END)) AS log_score,
                sum(CASE WHEN cuw > 0 THEN 0 ELSE 1 END)::BIGINT AS n_backoff
              FROM h JOIN n USING (doc_id) GROUP BY doc_id)
        SELECT n.doc_id, n.n_words::BIGINT AS n_words, round(coalesce(s.log_score, 0), 4) AS log_score, coalesce(s.n_backoff, 0)::BIGINT AS n_backoff
        FROM n LEFT JOIN s USING (doc_id)
    """,
}
