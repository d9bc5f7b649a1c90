"""The quality rules said in SQL: same counts, same bins, same fences."""

from __future__ import annotations

from evledger.llm.quality import MAX_REPEAT_PERCENT, MIN_GROUP, MIN_WORDS, REACH, RULES

WORD = r"[^\x20\x09-\x0D]+"


def _fences(keys: str, source: str) -> str:
    names = keys or "1"
    limits = []
    for rule in RULES:
        wide = f"{REACH} * (q3 - q1)"
        limits.append(f"max(q3 + {wide} + {rule.slack}) FILTER (rule = '{rule.name}') AS {rule.name}_most")
        if rule.low:
            limits.append(f"max(q1 - {wide} - {rule.slack}) FILTER (rule = '{rule.name}') AS {rule.name}_least")
    group = f"{keys}, " if keys else ""
    return f"""
        SELECT {group} max(total) AS size, {", ".join(limits)} FROM (
            SELECT {group} rule, max(total) AS total,
                   min(bin) FILTER (4 * upto >= total) AS q1, min(bin) FILTER (4 * upto >= 3 * total) AS q3
            FROM (
                SELECT *, sum(n) OVER (PARTITION BY {names}, rule ORDER BY bin) AS upto,
                       sum(n) OVER (PARTITION BY {names}, rule) AS total
                FROM (SELECT {group} rule, bin, sum(n) AS n FROM {source} GROUP BY {group} rule, bin)
            ) GROUP BY {group} rule
        ) {"GROUP BY " + keys if keys else ""}"""


def oracle() -> str:
    values = "\n        UNION ALL ".join(f"SELECT r, lang, source, '{r.name}' AS rule, m_{r.name} AS v FROM m" for r in RULES)
    tests = []
    for rule in RULES:
        for end, sign in (("most", ">"), *((("least", "<"),) if rule.low else ())):
            side = f"{rule.name}_{end}"
            limit = (
                f"CASE WHEN f.size >= {MIN_GROUP} THEN f.{side} WHEN g.size >= {MIN_GROUP} THEN g.{side} ELSE a.{side} END"
            )
            tests.append(f"(b.rule = '{rule.name}' AND b.bin {sign} {limit})")
    return f"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS l
        FROM documents
    ), wins AS (
        SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
    ), rep AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
    cov AS (
        SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r
    ), q AS (
        SELECT d.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
               length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
               len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines,
               length(t) - length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D]+', '', 'g')) AS n_marks,
               length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) AS n_capitals
        FROM d LEFT JOIN cov USING (r)
    ), base AS (
        SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM q
    ), m AS (
        SELECT r, lang, source,
               1000 * n_symbols // greatest(n_words, 1) AS m_symbols,
               1000 * n_dup_lines // greatest(n_lines, 1) AS m_dup_lines,
               1000 * n_repeat_words // greatest(n_words, 1) AS m_repeats,
               1000 * word_chars // greatest(n_words, 1) AS m_word_length,
               1000 * n_marks // greatest(word_chars, 1) AS m_marks,
               1000 * n_capitals // greatest(word_chars, 1) AS m_capitals
        FROM base WHERE NOT base_failed
    ), b AS (
        SELECT r, lang, source, rule, (v // s) * s AS bin
        FROM (SELECT *, (1::BIGINT << greatest(length(bin(v)) - 7, 0)::INT) AS s FROM ({values}))
    ), k AS (SELECT lang, source, rule, bin, count(*) AS n FROM b GROUP BY lang, source, rule, bin),
    f AS ({_fences("lang, source", "k")}),
    g AS ({_fences("lang", "k")}),
    a AS ({_fences("", "k")}),
    broken AS (
        SELECT DISTINCT b.r FROM b
        JOIN f ON f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source
        JOIN g ON g.lang IS NOT DISTINCT FROM b.lang CROSS JOIN a
        WHERE {" OR ".join(tests)}
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND r NOT IN (SELECT r FROM broken) AS kept
    FROM base
    """
