"""The Merkle manifest and the resampling draw in DuckDB's SQL."""

from __future__ import annotations

#: ``crc.t``: CRC-32 of each byte; the rows of a recursion over its eight bits.
_CRC_TABLE = """
    bits AS (
        SELECT i::UBIGINT AS i, i::UBIGINT AS v, 0 AS k FROM range(256) AS r(i)
        UNION ALL
        SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
    ), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"""


def _crc(hexes: str) -> str:
    """CRC-32 of the bytes that ``hexes`` names, two digits each."""
    octet = f"('0x' || substr({hexes}, 2 * i + 1, 2))::UBIGINT"
    listed = f"[4294967295::UBIGINT] || list_transform(range(0, (length({hexes}) // 2)::BIGINT), lambda i: {octet})"
    return f"xor(list_reduce({listed}, lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"


def resampling() -> str:
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = "w || list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])"
    return f"""
    WITH RECURSIVE {_CRC_TABLE},
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS w FROM documents),
    b AS (SELECT coalesce({words}, []) AS w FROM benchmark),
    f AS (SELECT r, unnest({grams}) AS g FROM d),
    e AS (SELECT unnest({grams}) AS g FROM b),
    h AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM f UNION SELECT g FROM e)),
    k AS (SELECT g, {_crc("x")} % 10000 AS bucket FROM h, crc),
    s AS (SELECT bucket, count(*) AS n FROM f JOIN k USING (g) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM e JOIN k USING (g) GROUP BY bucket),
    total AS (SELECT (SELECT count(*) FROM f) + 10000 AS s, (SELECT count(*) FROM e) + 10000 AS t),
    gain AS (
        SELECT a.bucket, floor(1000 * ln(
            ((coalesce(t.n, 0) + 1)::DOUBLE * total.s::DOUBLE) / ((a.n + 1)::DOUBLE * total.t::DOUBLE)))::BIGINT AS gain
        FROM s AS a LEFT JOIN t USING (bucket), total
    ),
    m AS (
        SELECT r, count(*) AS n_features, (floor(sum(gain)::DOUBLE / count(*)))::BIGINT AS weight
        FROM f JOIN k USING (g) JOIN gain USING (bucket) GROUP BY r
    ),
    scored AS (
        SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + floor(-1000 * ln(-ln((
                   ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE
               ) / 4294967296::DOUBLE)))::BIGINT AS score
        FROM d LEFT JOIN m USING (r)
    ),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
               count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
    )
    SELECT doc_id, n_features, weight, score,
           CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank
    FROM placed
    """


def merkle() -> str:
    def field(name: str) -> str:
        return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"

    def digest(text: str = "text") -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    # Both kinds of tree climb in one recursion; a tree that has one node left stops.
    def climb(name: str, leaves: str) -> str:
        return f"""
    {name} AS (
        SELECT tree, 0 AS depth, pos, d, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
        UNION ALL
        SELECT tree, depth + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 2) // 3
        FROM {name} WHERE n > 1 GROUP BY tree, depth, pos // 3
    ),
    {name}_steps AS (
        SELECT a.tree, a.depth, a.pos,
               coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
               coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
        FROM {name} AS a JOIN {name} AS b
          ON a.tree = b.tree AND a.depth = b.depth AND a.pos // 3 = b.pos // 3
        WHERE a.n > 1 GROUP BY a.tree, a.depth, a.pos
    )"""

    def paths(name: str, leaves: str) -> str:
        return f"""
    {name}_paths AS (
        SELECT l.tree, l.pos, list(struct_pack(before := s.before, after := s.after) ORDER BY s.depth) FILTER (s.tree IS NOT NULL) AS steps
        FROM {leaves} AS l LEFT JOIN {name}_steps AS s ON l.tree = s.tree AND l.pos // (3 ** s.depth)::BIGINT = s.pos
        GROUP BY l.tree, l.pos
    )"""

    return f"""
    WITH RECURSIVE {_CRC_TABLE},
    d AS (
        SELECT doc_id, coalesce('=' || source, '') AS tree, {digest()} AS d,
               CASE WHEN {_crc("hex(encode(coalesce(doc_id::VARCHAR, '')))")} % 2 = 0
                    THEN {digest("replace(text, chr(10), '')")} END AS forged
        FROM documents, crc
    ),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM d),
    {climb("low", "leaves")}, {paths("low", "leaves")},
    subroots AS (SELECT tree, d FROM low WHERE n = 1),
    named AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, d FROM subroots),
    {climb("high", "named")}, {paths("high", "named")},
    top AS (SELECT d AS root FROM high WHERE n = 1),
    proved AS (
        SELECT l.doc_id, l.d AS leaf, u.d AS subroot, root, coalesce(l.forged, l.d) AS start,
               coalesce(p.steps, []) || coalesce(q.steps, []) AS steps
        FROM leaves AS l JOIN low_paths AS p USING (tree, pos) JOIN subroots AS u USING (tree)
        JOIN named AS m ON m.name = l.tree JOIN high_paths AS q ON q.pos = m.pos, top
    ),
    folded AS (
        SELECT *, sha256(array_to_string(list_transform(steps, lambda s: s.before || s.after), '')) AS proof_sha256,
               list_reduce([struct_pack(before := start, after := '')] || steps,
                           lambda a, s: struct_pack(before := sha256(s.before || a.before || s.after), after := '')).before AS folded_root
        FROM proved
    )
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
    """
