"""SQL twins, for DuckDB, of the corpus queries that SQL can express."""

from tessel.functions.hashing import SPAN, uniform_sql
from tessel.llm import embdedup, mixing, urlfilter

#: Base32 of a SHA-1: five hex digits are four signs.
OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT body, max(page_id) AS target, sha1(body) AS hex FROM p GROUP BY body)
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> target THEN target END AS refers_to
FROM p JOIN d USING (body)
"""

#: All pairs of a label by cosine; the codes of the query only find candidates for the same test.
OP9 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
), sound AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {embdedup.THRESHOLD}
), reach AS (
  SELECT vec_id AS id, vec_id AS root FROM v
  UNION
  SELECT dst, root FROM reach JOIN links ON src = id
), low AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
many AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(vec_id = coalesce(root, vec_id), true) AS kept
FROM embeddings LEFT JOIN low ON id = vec_id LEFT JOIN many ON src = vec_id
"""

_STATED = ", ".join("('{}', '{}', '{}', '/{}')".format(said, rule, *rule.split("/", 1)) for said, rule in urlfilter.RULES)
_LOW = f"'{urlfilter._UPPER}', '{urlfilter._LOWER}'"
_NAMED = "list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: '{kind}:' || x)"


def _named(kind: str, parts: str) -> str:
    return _NAMED.format(kind=kind, parts=parts)


#: All combinations of tokens are counted where the query mines and matches them by index.
OP7 = f"""
WITH stated(said, rule, site, prefix) AS (VALUES {_STATED}),
p AS (
  SELECT row_number() OVER () AS k, page_id, url, translate(coalesce(regexp_extract(url, '{urlfilter._PARTS}', 1), ''), {_LOW}) AS host,
         coalesce(regexp_extract(url, '{urlfilter._PARTS}', 2), '') AS path, coalesce(regexp_extract(url, '{urlfilter._PARTS}', 3), '') AS rest,
         translate(coalesce(regexp_extract(url, '(?s)^(.*?)://', 1), ''), {_LOW}) AS scheme
  FROM pages
), tok AS (
  SELECT k, page_id, url, host, path, list_sort(list_distinct(list_concat(
    {_named("scheme", "[scheme]")}, {_named("label", "string_split(host, '.')")}, {_named("word", "string_split_regex(host, '[.-]')")},
    {_named("path", "list_transform(string_split(path, '/'), lambda y: regexp_replace(y, '[0-9]+', '#', 'g'))")},
    {_named("query", "list_transform(string_split(regexp_extract(rest, '^[?]([^#]*)', 1), '&'), lambda y: split_part(y, '=', 1))")}
  ))) AS ts FROM p
), fit AS (
  SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
  FROM p JOIN stated ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, prefix) GROUP BY k
), item AS (SELECT k, said, unnest(ts) AS t FROM fit JOIN tok USING (k)),
sets AS (
  SELECT k, said, [t] AS s FROM item
  UNION ALL SELECT a.k, a.said, [a.t, b.t] FROM item a JOIN item b ON a.k = b.k AND a.t < b.t
  UNION ALL SELECT a.k, a.said, [a.t, b.t, c.t] FROM item a JOIN item b ON a.k = b.k AND a.t < b.t JOIN item c ON b.k = c.k AND b.t < c.t
), counted AS (SELECT s, said, count(*) AS n, sum(count(*)) OVER (PARTITION BY s) AS whole FROM sets GROUP BY s, said),
sure AS (
  SELECT s, said, n::DOUBLE / whole AS confidence, n::DOUBLE / (SELECT count(*) FROM fit) AS support FROM counted
  WHERE n >= ceil({urlfilter.SUPPORT}::DOUBLE * (SELECT count(*) FROM fit)) AND n::DOUBLE / whole >= {urlfilter.CONFIDENCE}::DOUBLE
), mined AS (
  SELECT * FROM sure r WHERE NOT EXISTS (SELECT 1 FROM sure q WHERE q.said = r.said AND len(q.s) < len(r.s) AND q.confidence >= r.confidence AND list_has_all(r.s, q.s))
), free AS (SELECT DISTINCT url, ts FROM tok WHERE url IS NOT NULL AND k NOT IN (SELECT k FROM fit)),
met AS (
  SELECT url, said, row_number() OVER (PARTITION BY url ORDER BY confidence DESC, support DESC, len(s) DESC, array_to_string(s, ' ') DESC, said DESC) AS place
  FROM free JOIN mined ON list_has_all(ts, s)
)
SELECT page_id, host, path, rule, coalesce(fit.said, met.said, 'allow') AS verdict
FROM tok LEFT JOIN fit USING (k) LEFT JOIN met ON met.url = tok.url AND met.place = 1
"""

_HEX = "CAST('0x' || substr(h, {at}, 8) AS BIGINT)"
OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS s, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     r AS (SELECT *, length(s) AS n, {", ".join(f"{_HEX.format(at=8 * i + 1)} AS h{i + 1}" for i in range(4))} FROM d),
     c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
     t AS (SELECT *, substr(s, 1, a) AS p, substr(s, a + 1, b - a) AS m, substr(s, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(s) AS restored_sha256
FROM t
"""

#: The source at which the rate stops rising is the first, by bound over weight, that isn't bounded.
OP13 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS size FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS words, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
     o AS (SELECT *, row_number() OVER w AS pos, sum(3 * words) OVER w - 3 * words AS bounded, sum(weight) OVER () - sum(weight) OVER w + weight AS rest
           FROM s WINDOW w AS (ORDER BY 3.0::DOUBLE * words / weight, source ROWS UNBOUNDED PRECEDING)),
     q AS (SELECT *, ((SELECT sum(words) FROM s) - bounded)::DOUBLE / rest AS rate FROM o),
     r AS (SELECT coalesce(arg_min(rate, pos) FILTER (3 * words > rate * weight), 0) AS rate FROM q),
     t AS (SELECT s.source, words, least(3.0::DOUBLE * words, r.rate * weight) AS target,
           {uniform_sql(13, "(s.source IS NULL)::INT", "coalesce(s.source, '')")} / {SPAN} AS u FROM s, r),
     k AS (SELECT d.*, words, target, u, CASE WHEN words > 0 THEN target / words ELSE 0 END AS c,
           row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) - 1 AS i FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, words AS source_size, target, CAST(least(floor((i + 1) * c + u) - floor(i * c + u), 3) * size AS BIGINT) AS taken FROM k
"""

ORACLES = {"op7_url_filter": OP7, "op8_warc": OP8, "op9_embedding_dedup": OP9, "op11_fill_in_middle": OP11, "op13_mixing": OP13}
