"""DuckDB SQL of the queries whose statements are built from parts."""

from __future__ import annotations

from inkstream.llm import quality_rules
from inkstream.llm.merkle import FIELDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(text: str) -> str:
    """The CRC-32 of a string's UTF-8: each byte is mixed in and then shifted out bit by bit (-1 stands for a shift)."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    steps = f"flatten(list_transform(range(0, strlen({text})), lambda i: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(4294967295::BIGINT, list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE {shift} END, 4294967295::BIGINT))"


def quality_rules_cutoffs() -> str:
    rows = [f"({r}, {at}, {cutoff})" for r, rule in enumerate(quality_rules.RULES) for at, cutoff in enumerate(rule.cutoffs)]
    return ", ".join(rows)


def quality_rules_sql(rate: float = quality_rules.RATE, error: float = quality_rules.ERROR) -> str:
    rules = quality_rules.RULES
    have = "CASE r " + " ".join(f"WHEN {i} THEN 100 * {x.figure}" for i, x in enumerate(rules)) + " END"
    base = "CASE r " + " ".join(f"WHEN {i} THEN {x.of}" for i, x in enumerate(rules)) + " END"
    below = ", ".join(str(i) for i, x in enumerate(rules) if not x.above)
    rejects = f"CASE WHEN r IN ({below}) THEN {have} < {base} * cutoff ELSE {have} > {base} * cutoff END"
    p = rate / len(rules)
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln({1 - p!r}))"
    return f"""
        WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
        windows AS (SELECT doc_id, i, list_slice(words, i, i + 2) AS three FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
        often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS c FROM windows) WHERE c > 1),
        repeated AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS pos FROM often) GROUP BY doc_id),
        lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
        f AS (SELECT w.doc_id, lang, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
              length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines
              FROM w JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
        cutoffs(r, pos, cutoff) AS (VALUES {quality_rules_cutoffs()}),
        good AS (SELECT b.* FROM b JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
        counts AS (SELECT lang, r, pos, count(*) AS n, count(*) FILTER (WHERE {rejects}) AS k FROM good, cutoffs GROUP BY lang, r, pos),
        tested AS (SELECT lang, r, pos, k < n * {p!r} AND list_sum(list_transform(range(0, CASE WHEN k < n * {p!r} THEN k + 1 ELSE 1 END), lambda i: {term})) <= {error!r} / ({len(rules)} * (SELECT count(DISTINCT coalesce('=' || lang, '')) FROM b)) AS ok FROM counts),
        chosen AS (SELECT lang, r, max(pos) AS pos FROM (SELECT lang, r, pos, bool_and(ok) OVER (PARTITION BY lang, r ORDER BY pos) AS ok FROM tested) WHERE ok GROUP BY lang, r),
        gone AS (SELECT DISTINCT doc_id FROM b JOIN chosen ON b.lang IS NOT DISTINCT FROM chosen.lang JOIN cutoffs USING (r, pos) WHERE {rejects})
        SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND doc_id NOT IN (FROM gone) AS kept FROM b
    """


def spelling_variants_sql() -> str:
    return f"""
        WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
        distinct_runs AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
        hashed AS (SELECT run, c, {crc32("(doc_id || ':' || run)")} AS h FROM distinct_runs),
        spoilt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
        words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
        cut AS MATERIALIZED (SELECT word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM words)),
        near AS MATERIALIZED (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, n, count(*) AS n_near, min({{'m': -other_n, 'w': other}}) AS b FROM near GROUP BY word, n),
        forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * w.n THEN b.w END AS form, CASE WHEN -b.m >= 5 * w.n THEN -b.m END AS form_n FROM words w LEFT JOIN best USING (word)),
        chain AS (SELECT word, form AS upto, 1 AS step FROM forms WHERE form IS NOT NULL
                  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON c.upto = f.word WHERE f.form IS NOT NULL),
        ends AS (SELECT word, arg_max(upto, step) AS root FROM chain GROUP BY word)
        SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
    """


def merkle_manifest_sql(levels: int = 7, upper: int = 3) -> str:
    """Trees of up to 8 ** ``levels`` documents a lang and 8 ** ``upper`` langs, level by level."""

    def field(name: str, value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    leaf = " || ".join(field(c, c) for c in FIELDS)
    lowered = " || ".join(field(c, f"translate(text, '{UPPER}', '{LOWER}')" if c == "text" else c) for c in FIELDS)
    parts = [
        f"leaf AS (SELECT doc_id, lang, sha256({leaf}) AS leaf, sha256({lowered}) AS lowered FROM documents)",
        f"docs AS (SELECT *, CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN lowered ELSE leaf END AS start, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf)",
        "n0 AS (SELECT g, i, leaf AS d FROM docs)",
    ]

    def grow(name: str, depth: int) -> None:
        for k in range(depth):
            parts.append(f"{name}s{k} AS MATERIALIZED (SELECT g, i, d, count(*) OVER (PARTITION BY g) > 1 AS more, coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN bool_or(more) THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d FROM {name}s{k} GROUP BY g, i // 8)")

    grow("n", levels)
    parts.append(f"u0 AS (SELECT 0 AS g, g AS i, d FROM n{levels})")
    grow("u", upper)
    parts.append("f0 AS (SELECT doc_id, leaf, g, i, start AS f, '' AS proof FROM docs)")
    step = "CASE WHEN s.more THEN sha256(s.b || f || s.a) ELSE f END AS f, proof || s.b || s.a AS proof"
    for k in range(levels):
        parts.append(f"f{k + 1} AS (SELECT doc_id, leaf, p.g, p.i, {step} FROM f{k} p JOIN ns{k} s ON s.g = p.g AND s.i = p.i // {8**k})")
    for k in range(upper):
        parts.append(f"f{levels + k + 1} AS (SELECT doc_id, leaf, p.g, p.i, {step} FROM f{levels + k} p JOIN us{k} s ON s.i = p.g // {8**k})")
    return f"""
        WITH {", ".join(parts)}
        SELECT doc_id, leaf, n{levels}.d AS subroot, u{upper}.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = u{upper}.d AS verified
        FROM f{levels + upper} p JOIN n{levels} ON n{levels}.g = p.g, u{upper}
    """
