"""DuckDB SQL for the queries whose results SQL can state directly."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str) -> str:
    """CTEs d (doc_id, w) and words (doc_id, p from 1, word)."""
    return f"""
    d AS (SELECT doc_id, regexp_extract_all(coalesce({text}, ''), '{_WORD}') AS w FROM documents),
    words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d)"""


def _windows(width: int) -> str:
    """CTE win (doc_id, p, s): every window of `width` words."""
    return f"""
    win AS (SELECT doc_id, p, s FROM (
        SELECT doc_id, p, count(*) OVER w AS n, list(word) OVER w AS s FROM words
        WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING))
        WHERE n = {width})"""


_REACH = """
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(a, b) AS (SELECT a, b FROM both_ways UNION
                    SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
    least AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)"""

EMBEDDING = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
             WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
               AND list_dot_product(e, e) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y
              ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
              WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.9),{_REACH},
    counts AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
       vec_id <= coalesce(c, vec_id) AS kept
FROM v LEFT JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""

JACCARD = f"""
WITH RECURSIVE {_words(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")},
    shingles AS (
        SELECT DISTINCT doc_id, s FROM (
            SELECT doc_id, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS s FROM words
            WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE s IS NOT NULL
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
    links AS (
        SELECT a, b FROM (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
            FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2)
        JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
        WHERE 100 * k >= 90 * (p.n + q.n - k)),{_REACH}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""

SUBSTRING = f"""
WITH {_words("text")},{_windows(20)},
    later AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
    gone AS (SELECT DISTINCT doc_id, p + k AS p FROM later CROSS JOIN range(20) t(k)),
    removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p)
             GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_RULES = {
    "short": "n_words < 20",
    "repeats": "n_repeat_words * 100 > n_words * 30",
    "symbols": "n_symbols * 10 > n_words",
    "dup_lines": "n_dup_lines * 100 > n_lines * 30",
}


def _rate(rule: str) -> str:
    """The shrunken rate of one rule for every host."""
    return f"""
    sum_{rule} AS (SELECT least(greatest(sum(f_{rule}) / sum(n_docs), 1e-9), 1 - 1e-9) AS mean,
                          sum(f_{rule} * f_{rule} / n_docs) / sum(n_docs) AS q, count(*) / sum(n_docs) AS k
                   FROM hosts),
    rate_{rule} AS (SELECT host, (f_{rule} + mean * strength) / (n_docs + strength) AS rate FROM hosts, (
        SELECT mean, least(greatest(mean * (1 - mean)
                   / greatest(q - mean * mean - mean * (1 - mean) * k, 1e-12) - 1, 1.0), 1000.0) AS strength
        FROM sum_{rule}))"""


QUALITY = f"""
WITH {_words("text")},{_windows(8)},
    often AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
    covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM often CROSS JOIN range(8) t(k) GROUP BY 1),
    lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
        WHERE regexp_matches(l, '{_WORD}') GROUP BY 1),
    m AS (SELECT s.doc_id, s.source AS host, len(w)::BIGINT AS n_words,
            coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
            coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
            coalesce(lines.n, 0) AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines,
            coalesce(covered.n, 0)::BIGINT AS n_repeat_words
          FROM documents s JOIN d USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
    hosts AS (SELECT host, count(*)::DOUBLE AS n_docs,
              {", ".join(f"count(*) FILTER ({c})::DOUBLE AS f_{r}" for r, c in _RULES.items())}
              FROM m WHERE host IS NOT NULL GROUP BY 1),{",".join(_rate(r) for r in _RULES)},
    bad AS ({" UNION ".join(f"SELECT host FROM rate_{r} WHERE rate > 0.5" for r in _RULES)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {_RULES["short"]} OR {_RULES["repeats"]} AS base_failed,
       NOT ({_RULES["short"]} OR {_RULES["repeats"]}) AND bad.host IS NULL AS kept, bad.host IS NOT NULL AS host_failed
FROM m LEFT JOIN bad ON bad.host = m.host
"""


def vector_codes_sql(rounds: int = 4) -> str:
    """Product codebooks: whole numbers below 2^53 are exact in doubles, so products give exact distances."""
    steps = ["""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS x FROM k, range(4) AS r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min(struct_pack(
    d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), e := entry)) AS near
  FROM p JOIN b{i} USING (part) GROUP BY vec_id, part)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT part, entry, list(c ORDER BY pos) AS c FROM (
    SELECT part, near.e AS entry, pos, floor((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) / count(*)) AS c
    FROM (SELECT part, near, generate_subscripts(x, 1) AS pos, unnest(x)::BIGINT AS v FROM a{i}) GROUP BY part, entry, pos)
  GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (part, entry))""")
    return ",\n".join(steps) + f""",
g AS (SELECT vec_id, string_agg(lpad(lower(to_hex(near.e::BIGINT)), 2, '0'), '' ORDER BY part) AS code,
  sum(near.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN g USING (vec_id), h
"""
