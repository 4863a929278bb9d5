"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_quality_rules": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
            FROM documents
        ), win AS (
            SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
        ), again AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id
        ), m AS (
            SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                   (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
                   (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
                   len(ls)::BIGINT AS n_lines,
                   len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
                   length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
                   length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))::BIGINT AS n_letters,
                   len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::BIGINT AS n_stutters
            FROM d LEFT JOIN covered c USING (doc_id)
        ), f AS (
            SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
                   + 8 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT
                   + 16 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT
                   + 32 * (10 * n_letter_words < 6 * n_words)::BIGINT + 64 * (2 * n_upper > n_letters)::BIGINT
                   + 128 * (10 * n_stutters > 3 * n_words)::BIGINT AS failed
            FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed
        FROM f
    """,
    "op8_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
        win AS (
            SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS least
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
        ),
        gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win WHERE least < doc_id) GROUP BY doc_id),
        word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d JOIN gone USING (doc_id)),
        rest AS (
            SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t
            FROM word ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) USING (doc_id, p) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
               sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN rest USING (doc_id)
    """,
}
