"""SQL twins of the numbered queries that SQL can express on small tables."""

from __future__ import annotations

from rolloom.llm import minhash, secrets


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def linked_secrets(scope: int = secrets.SCOPE) -> str:
    """The secret report: positions are running sums of matches and the pieces between them."""
    patterns = [secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.IDENT, secrets.OPAQUE, secrets.ENDPOINT_PLAIN]
    found = " UNION ALL ".join(
        f"SELECT rid, {i} AS kind, regexp_extract_all(t, {_quoted(p)}) AS m, string_split_regex(t, {_quoted(p)}) AS g, "
        + (f"regexp_extract_all(t, {_quoted(p)}, 2)" if i == 0 else "m")
        + " AS p FROM d"
        for i, p in enumerate(patterns)
    )
    names = ", ".join(f"'{k}'" for k in secrets.KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
each AS (SELECT rid, kind, unnest(range(1, len(m) + 1)) AS i, m, g, p FROM found WHERE len(m) > 0),
placed AS (SELECT rid, kind, length(m[i]) AS n,
  CASE kind WHEN 0 THEN length(p[i]) >= 6 WHEN 4 THEN regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[0-9]') WHEN 5 THEN contains(m[i], '{secrets.IS_URL}') OR regexp_matches(m[i], '{secrets.IS_HOST}') ELSE true END AS ok,
  sum(length(g[i]) + length(m[i])) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM each),
parts AS (SELECT rid, kind, e - n AS s, e, CASE WHEN kind IN (0, 2, 4) THEN 'secret' WHEN kind IN (1, 3) THEN 'identifier' ELSE 'endpoint' END AS role FROM placed WHERE ok),
kept AS (SELECT rid, kind, s, e FROM parts WHERE kind < 3 UNION ALL
  SELECT rid, kind, s, e FROM parts w WHERE kind >= 3 AND EXISTS (SELECT 1 FROM parts o WHERE o.rid = w.rid AND o.role <> w.role
    AND (o.role = 'secret' OR w.role = 'secret') AND o.s <= w.e + {scope} AND w.s <= o.e + {scope})),
told AS (SELECT rid, kind, [{names}][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x, s FROM kept),
sums AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans FROM told GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums USING (rid)"""


def near_duplicates(threshold: float = minhash.THRESHOLD, words: int = minhash.SHINGLE) -> str:
    """Classes of near copies by comparing every pair of texts that share a shingle."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\x0B\\x0C]+'), lambda x: x <> '') AS a FROM documents),
k AS (SELECT array_to_string(a, ' ') AS node, min(doc_id) AS id, count(*) AS n_rows, any_value(a) AS a FROM w GROUP BY 1),
s AS (SELECT DISTINCT id, sh FROM (SELECT id, unnest(CASE WHEN len(a) >= {words} THEN list_transform(range(1, len(a) - {words - 2}), lambda i: array_to_string(a[i:i + {words - 1}], ' ')) WHEN len(a) > 0 THEN [node] ELSE [] END) AS sh FROM k)),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.id < y.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE i >= {threshold} * (ca.n + cb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS other FROM k UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
g AS (SELECT r.id, min(r.other) AS class_id, CAST(sum(k.n_rows) AS BIGINT) AS class_rows FROM r JOIN k ON k.id = r.other GROUP BY r.id)
SELECT doc_id, class_id, class_rows FROM w JOIN k ON k.node = array_to_string(w.a, ' ') JOIN g ON g.id = k.id"""


def archived_pages() -> str:
    """What an archive of all pages must give back."""
    return """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, n >= 100 AND row_number() OVER (PARTITION BY d ORDER BY page_id NULLS LAST) > 1 AS again,
  first_value(page_id) OVER (PARTITION BY d ORDER BY page_id NULLS LAST) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM r"""
