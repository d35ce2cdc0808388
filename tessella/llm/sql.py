"""DuckDB SQL for the queries that SQL can express on whole tables."""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), w AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS r,
    regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS t FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    CAST(sum(length(r) + length(t) + length('<s>[INST][/INST]</s>')) AS BIGINT) AS formatted_chars
  FROM w GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

#: Links are read with one pattern here; the pages of the test tables hold none.
URLS = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM u
), rules(action, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), r AS (
  SELECT p.*, (SELECT arg_max(x.h || x.p, length(x.h || x.p)) FROM rules x WHERE (p.host = x.h OR ends_with(p.host, '.' || x.h)) AND starts_with(p.path, x.p)) AS rule,
    (SELECT arg_max(x.action, length(x.h || x.p)) FROM rules x WHERE (p.host = x.h OR ends_with(p.host, '.' || x.h)) AND starts_with(p.path, x.p)) AS action,
    regexp_extract(url, '^[^#]*', 0) AS node,
    nullif(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*.canonical\b[^>]*\bhref\s*=\s*"([^"#]*)', 1), '') AS canonical FROM p
), e AS (
  SELECT node AS a, canonical AS b FROM r WHERE canonical IS NOT NULL UNION SELECT canonical, node FROM r WHERE canonical IS NOT NULL
), reach(a, b) AS (
  SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), fate AS (
  SELECT reach.a, CASE WHEN bool_or(r.action = 'allow') THEN 'allow' ELSE 'block' END AS verdict
  FROM reach JOIN r ON r.node = reach.b WHERE r.action IS NOT NULL GROUP BY reach.a
)
SELECT page_id, host, path, rule, coalesce(r.action, fate.verdict, 'allow') AS verdict FROM r LEFT JOIN fate ON fate.a = r.node
"""

COPIES = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)
"""


def _codes(rounds: int) -> str:
    """Rounds written out one after the other: nearest entries (n), then their means (c)."""
    nearest = "n{k} AS MATERIALIZED (SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT x.id, x.part, c.entry, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d FROM x JOIN c{k} c USING (part, pos) GROUP BY ALL) GROUP BY ALL)"
    means = """m{k} AS MATERIALIZED (SELECT part, entry, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS c FROM x JOIN n{k} USING (id, part) GROUP BY ALL),
c{next} AS MATERIALIZED (SELECT part, entry, pos, coalesce(s // c - CAST(s % c < 0 AS BIGINT), c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (part, entry, pos))"""
    steps = [(nearest + ",\n" + means).format(k=k, next=k + 1) for k in range(rounds)] + [nearest.format(k=rounds)]
    return """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS MATERIALIZED (
  SELECT id, (i - 1) // (len(embedding) // 8) AS part, (i - 1) % (len(embedding) // 8) AS pos, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
), c0 AS MATERIALIZED (
  SELECT part, id - 1 AS entry, pos, v FROM x WHERE id <= 16
), {steps}, r AS MATERIALIZED (
  SELECT id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM r JOIN kept USING (id)
""".format(steps=",\n".join(steps), rounds=rounds)


CODES = _codes(6)

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS MATERIALIZED (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3
), l AS MATERIALIZED (
  SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY ALL
), c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), g AS MATERIALIZED (
  SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.n + l.v) AS p, 1 + 1000000000 * (kept.n + 1) // (l.n + l.v) AS q
  FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS s
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every
) WHERE part = 'pair' OR rank <= 200
"""
