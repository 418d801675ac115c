"""SQL for the results of queries that SQL can express, for another engine on the same tables."""

from __future__ import annotations

from pixelloom.llm.repetition import Rules

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"


def repetition(rules: Rules = Rules()) -> str:
    """op6: words and n-grams as rows; a word is covered if a repeated n-gram starts at most n - 1 words before it."""
    sizes = [n for n, _ in rules.coverage]
    gram = lambda n: " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))])
    parts = [
        "docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)",
        f"lists AS (SELECT rid, regexp_extract_all(text, '{WORD}') AS ws FROM docs)",
        "words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists)",
        "grams AS (SELECT rid, i, length(w) AS c, " + ", ".join(f"{gram(n)} AS g{n}" for n in sizes) + " FROM words WINDOW o AS (PARTITION BY rid ORDER BY i))",
        "twice AS (SELECT rid, i, c, " + ", ".join(f"CASE WHEN g{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, g{n}) > 1 THEN 1 ELSE 0 END AS d{n}" for n in sizes) + " FROM grams)",
        "covered AS (SELECT rid, c, " + ", ".join(f"max(d{n}) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS v{n}" for n in sizes) + " FROM twice)",
        "sums AS (SELECT rid, count(*) AS n_words, sum(c) AS word_chars, sum(v3) AS n_repeat_words, " + ", ".join(f"sum(v{n} * c) AS s{n}" for n in sizes) + " FROM covered GROUP BY rid)",
        "lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)",
        f"again AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY i) AS k FROM lines WHERE regexp_matches(line, '{WORD}'))",
        f"dups AS (SELECT rid, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '{SPACE}', '', 'g'))) AS dup_chars FROM again WHERE k > 1 GROUP BY rid)",
        "all_ AS (SELECT d.doc_id, d.text, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_chars, 0) AS dup_chars, "
        + ", ".join(f"coalesce(s{n}, 0) AS s{n}" for n in sizes)
        + " FROM docs d LEFT JOIN sums USING (rid) LEFT JOIN dups USING (rid))",
        f"judged AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {round(100 * rules.max_repeat_words)} * n_words AS base_failed FROM all_)",
    ]
    over = " OR ".join([f"dup_chars * 1e0 / greatest(word_chars, 1) > {rules.line_coverage}", *(f"s{n} * 1e0 / greatest(word_chars, 1) > {limit}" for n, limit in rules.coverage)])
    columns = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {columns}, base_failed, NOT (base_failed OR {over}) AS kept"
        " FROM (SELECT *, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM judged)"
    )


def decontamination(window: int = 10) -> str:
    """op9: windows of items joined with the windows of documents, by length and text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = lambda e: f"regexp_extract_all(translate(coalesce({e}, ''), '{upper}', '{lower}'), '{word}')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {cut('text')} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {cut('text')} AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least({window}, len(ws)) AS n FROM items WHERE len(ws) > 0),
starts AS (SELECT item_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM sized),
wins AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM starts),
lengths AS (SELECT DISTINCT n FROM wins),
places AS (SELECT rid, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM docs, lengths WHERE len(ws) >= n),
found AS (SELECT p.rid, p.i, p.n, w.item_id FROM (SELECT rid, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM places) p JOIN wins w ON p.n = w.n AND p.g = w.g),
hits AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS j FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)"""
