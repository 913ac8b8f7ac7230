"""DuckDB SQL for the queries of this subpackage that SQL can tell."""

from __future__ import annotations

from brindle.llm.licenses import CUT, PREPARED, RULES, SENTENCES

#: Words are runs of characters other than ASCII white space.
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest,
         regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#[\s\S]*$', '') AS rest
  FROM p
), h AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS host FROM d),
k AS (
  SELECT *, CASE WHEN rest = '' THEN '' ELSE
    array_to_string(list_reverse(string_split(regexp_replace(lower(host), '^www[0-9]*\.', ''), '.')), ',') || ')' ||
    CASE WHEN substr(rest, length(host) + 1) = '' THEN '/' ELSE substr(rest, length(host) + 1) END END AS url_key
  FROM h
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first FROM k
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, url_key,
       row_number() OVER (ORDER BY url_key, page_id) - 1 AS position
FROM f
"""

_MIXING = f"""
WITH d AS (
  SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
         CAST(source_size * 2 AS DOUBLE) AS bound
  FROM t
), r AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), g AS (
  SELECT *, least(bound, weight * coalesce(max(CASE WHEN level <= bound / weight THEN level END) OVER (), 0)) AS target FROM r
), x AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole, source_size::DOUBLE / source_rows AS mean FROM g
), y AS (SELECT *, target - whole * source_size AS rest FROM x),
h AS (
  SELECT source, size, count(*)::DOUBLE AS n FROM d WHERE size > 0 GROUP BY source, size
), c AS (
  SELECT h.source, h.size, mean, (rest - coalesce(sum(n * size) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / (sum(n * size * size) OVER a + mean * sum(n * size) OVER a) AS factor
  FROM h JOIN y ON h.source IS NOT DISTINCT FROM y.source WHERE rest > 0
  WINDOW a AS (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), z AS (SELECT source, arg_max(factor, size) AS factor FROM c WHERE factor * (size + mean) < 1 GROUP BY source),
q AS (
  SELECT d.doc_id, d.size, y.source_size, y.target, y.whole, y.rest, y.source, factor * (size + mean) AS p,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source LEFT JOIN z ON d.source IS NOT DISTINCT FROM z.source
), v AS (
  SELECT *, CASE WHEN p >= 1 THEN 0.0 ELSE u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS rank FROM q
), s AS (
  SELECT *, coalesce(sum(CASE WHEN rest > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND size > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM s
"""

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), r AS (
  SELECT doc_id, doc_id AS at FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.at
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.at) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""



def _licenses() -> str:
    """Sentences by two replacements, those of CUT from neighbouring pieces, then one step for each rule."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in SENTENCES.items())
    normal = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"
    text = "coalesce(text, '')"
    for pattern, to in PREPARED:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(to)}, 'g')"
    steps = []
    for i, (name, seq) in enumerate(RULES):
        key = quoted("".join(f"<{x}>" for x in seq))
        steps.append(f"r{i + 1} AS (SELECT doc_id, row, ids, replace(rest, {key}, '#') AS rest, CASE WHEN contains(rest, {key}) THEN list_append(found, {quoted(name)}) ELSE found END AS found FROM r{i})")
    return f"""
WITH known(id, sentence) AS (VALUES {known}),
d AS (SELECT doc_id, row_number() OVER () AS row, {text} AS text FROM documents),
s AS (
  SELECT row, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (
    SELECT row, string_split(regexp_replace(regexp_replace(text, '([.!?:;])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(30), 'g'), '\\n[ \\t\\r]*\\n', chr(30), 'g'), chr(30)) AS x FROM d
  )
), n AS (SELECT *, {normal.format("s")} AS norm FROM s),
p AS (SELECT *, norm || ' ' || lead(norm, 1) OVER o AS two, norm || ' ' || lead(norm, 1) OVER o || ' ' || lead(norm, 2) OVER o AS three FROM n WINDOW o AS (PARTITION BY row ORDER BY i)),
m AS (
  SELECT p.row, p.i, p.s, k.id, a.id AS two, b.id AS three FROM p LEFT JOIN known k ON k.sentence = p.norm
  LEFT JOIN (SELECT * FROM known WHERE id IN ({", ".join(map(quoted, CUT))})) a ON a.sentence = p.two
  LEFT JOIN (SELECT * FROM known WHERE id IN ({", ".join(map(quoted, CUT))})) b ON b.sentence = p.three
), t AS (
  SELECT *, lag(two, 1) OVER o IS NOT NULL OR lag(three, 1) OVER o IS NOT NULL OR lag(three, 2) OVER o IS NOT NULL AS inside FROM m WINDOW o AS (PARTITION BY row ORDER BY i)
), w AS (
  SELECT row, i, s, CASE WHEN two IS NOT NULL OR three IS NOT NULL THEN coalesce(two, three) WHEN NOT inside THEN id END AS id, two IS NULL AND three IS NULL AND (inside OR id IS NOT NULL) AS done FROM t
), l AS (SELECT row, i, unnest(y) AS line, generate_subscripts(y, 1) AS j FROM (SELECT row, i, string_split(s, chr(10)) AS y FROM w WHERE id IS NULL AND NOT done)),
f AS (
  SELECT row, i, 0 AS j, id FROM w WHERE id IS NOT NULL
  UNION ALL SELECT l.row, l.i, l.j, k.id FROM l JOIN known k ON k.sentence = {normal.format("l.line")}
), g AS (SELECT row, list(id ORDER BY i, j) AS ids FROM f GROUP BY row),
r0 AS (
  SELECT doc_id, d.row, coalesce(ids, []) AS ids, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS rest, CAST([] AS VARCHAR[]) AS found
  FROM d LEFT JOIN g USING (row)
), {", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentences,
       coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licenses
FROM r{len(RULES)}
"""


ORACLES: dict[str, str] = {"op2_warc": _WARC, "op5_ngram_jaccard": _JACCARD, "op6_mixing": _MIXING, "op8_licenses": _licenses()}
