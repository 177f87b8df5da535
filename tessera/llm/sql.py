"""SQL (DuckDB) for the operators that SQL can express on whole tables; line dedup has its own beside it."""

from __future__ import annotations

from tessera.llm.quality import LANGS, STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: What Python's str.split() cuts at.
BLANK = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS} AS w, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '') AS u FROM documents
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams), (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, d.lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, len(u) AS n_pieces, len(list_filter(u, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
    len(list_filter(u, lambda x: list_contains([{', '.join(f"'{w}'" for w in sorted(STOP_WORDS))}], lower(x)))) AS n_stop_words
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN lines l ON d.doc_id = l.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 3 * n_words AND 12 * n_words AND 2 * n_dup_lines <= n_lines AND ((lang IS NOT NULL AND lang NOT IN ({', '.join(f"'{x}'" for x in LANGS)})) OR n_stop_words >= 2)
  AND 10 * n_letter_words >= 7 * n_pieces AS kept
FROM b
"""

PASSAGES = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 34), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
repeated AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
judged AS (
  SELECT w.doc_id, w.i, word, coalesce(r.s >= w.i - 34, FALSE) AS gone FROM words w ASOF LEFT JOIN repeated r ON w.doc_id = r.doc_id AND w.i >= r.s
), kept AS (
  SELECT doc_id, sum(gone::BIGINT)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t FROM judged GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS s FROM d)),
repeated AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS least FROM windows) WHERE doc_id > least),
bytes AS (SELECT doc_id, s, substr(h, 2 * s + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(len(h) // 2)) AS s FROM d)),
judged AS (SELECT b.doc_id, b.s, b, coalesce(r.s > b.s - 50, FALSE) AS gone FROM bytes b ASOF LEFT JOIN repeated r ON b.doc_id = r.doc_id AND b.s >= r.s),
spans AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY s), FALSE) AS begins FROM judged),
kept AS (
  SELECT doc_id, sum(gone::BIGINT)::BIGINT AS n_removed, sum(begins::BIGINT)::BIGINT AS n_spans, string_agg(b, '' ORDER BY s) FILTER (WHERE NOT gone) AS t FROM spans GROUP BY doc_id
)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def links(steps: int = 20, damping: float = 0.85) -> str:
    """Host rules and both walks, a step for each table."""
    import string

    from tessera.llm.urlfilter import LINK, RULES

    def host(c: str) -> str:
        return f"translate(regexp_extract(coalesce({c}, ''), '(?s)^.*?://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for _, h, p in ordered]
    rule = " ".join(f + f"'{h}{p}'" for f, (_, h, p) in zip(fits, ordered))
    told = " ".join(f + f"'{v}'" for f, (v, _, _) in zip(fits, ordered))
    link = LINK.replace("'", "''")
    walk = "".join(
        f", r{i} AS MATERIALIZED (SELECT kind, host, sum(r) AS r FROM (SELECT kind, host, s * {1 - damping} AS r FROM start "
        f"UNION ALL SELECT w.kind, w.b, r.r * w.w * {damping} FROM walk w JOIN r{i - 1} r ON w.kind = r.kind AND w.a = r.host) GROUP BY kind, host)"
        for i in range(1, steps + 1)
    )
    return rf"""
WITH p AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {told} END AS told FROM (SELECT page_id, {host('url')} AS host, {path} AS path FROM pages)),
named AS (SELECT host, sum((told = 'allow')::INT) AS allowed, sum((told = 'block')::INT) AS blocked FROM p WHERE told IS NOT NULL GROUP BY host),
start AS (
  SELECT * FROM (SELECT 1 AS kind, host, allowed / nullif(sum(allowed) OVER (), 0) AS s FROM named UNION ALL SELECT 2, host, blocked / nullif(sum(blocked) OVER (), 0) FROM named) WHERE s > 0
), found AS (SELECT {host('url')} AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM pages),
edges AS (
  SELECT src, dst, count(*) AS n FROM (SELECT src, {host("CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END")} AS dst FROM found WHERE regexp_matches(link, '^([A-Za-z][A-Za-z0-9+.-]*:)?//'))
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), walk AS (SELECT 1 AS kind, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS w FROM edges UNION ALL SELECT 2, dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges),
r0 AS (SELECT kind, host, s AS r FROM start){walk},
bad AS (SELECT host FROM r{steps} GROUP BY host HAVING round(coalesce(sum(r) FILTER (WHERE kind = 2), 0), 12) > round(coalesce(sum(r) FILTER (WHERE kind = 1), 0), 12))
SELECT page_id, p.host, path, rule, coalesce(told, CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN bad b ON p.host = b.host
"""
