"""DuckDB SQL for the queries that SQL can express."""

from tessera.llm import url_filter
from tessera.llm.license_scan import TEMPLATES

_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_RULES = ", ".join(f"('{r}', '{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for r, v in url_filter.RULES)
_SUFFIXES = ", ".join(f"'{s}'" for s in url_filter.SUFFIXES)


def _level(children: str, parent: str, key: str, mean: str, keep: str) -> str:
    """Posterior means of children around their parents'."""
    m = f"p.{mean}"
    return f"""(
  WITH c AS (SELECT {keep}, c.n, c.y, {m} AS m FROM {children} AS c JOIN {parent} AS p {key}),
  k AS (SELECT 1 / least({url_filter.MOST_RHO}::DOUBLE, greatest({url_filter.LEAST_RHO}::DOUBLE, round(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0
        THEN sum((y - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) ELSE 0 END, 6))) - 1 AS k FROM c)
  SELECT c.*, (k * m + y) / (k + n) AS rate, k + n AS weight FROM c, k)"""


ORACLE_SQL: dict[str, str] = {
    "op9_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)
), dup AS (
  SELECT s FROM win GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p
  FROM (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM dup)), (SELECT unnest(range(0, 35)) AS j)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) AS a
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op8_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), bw AS (
  SELECT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), hit AS (
  SELECT doc_id, i, n, s FROM dw WHERE (s, n) IN (SELECT (s, n) FROM bw)
), pos AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit JOIN bw USING (s, n)) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op5_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op6_license_scan": rf"""
WITH t AS (
  SELECT license, regexp_extract_all(lower(body), '[a-z0-9]+') AS ws FROM (VALUES {_TEMPLATES}) AS v(license, body)
), tb AS (
  SELECT DISTINCT license, ws[i] AS a, ws[i + 1] AS b FROM (SELECT license, ws, unnest(range(1, len(ws))) AS i FROM t)
), parts AS (
  SELECT DISTINCT doc_id, part FROM (
    SELECT doc_id, unnest(string_split(text, chr(10)) || regexp_split_to_array(text, '\n[ \t\r\f\v]*\n') || [text]) AS part FROM documents WHERE text IS NOT NULL)
), words AS (
  SELECT row_number() OVER () AS part_id, doc_id, regexp_extract_all(lower(part), '[a-z0-9]+') AS ws FROM parts
), pb AS (
  SELECT DISTINCT part_id, doc_id, ws[i] AS a, ws[i + 1] AS b FROM (SELECT part_id, doc_id, ws, unnest(range(1, len(ws))) AS i FROM words)
), np AS (SELECT part_id, count(*) AS n FROM pb GROUP BY ALL
), nt AS (SELECT license, count(*) AS n FROM tb GROUP BY ALL
), both_ AS (
  SELECT part_id, doc_id, license, count(*) AS c FROM pb JOIN tb USING (a, b) GROUP BY ALL
), d AS (
  SELECT doc_id, license, 2.0::DOUBLE * c / (np.n + nt.n) AS dice FROM both_ JOIN np USING (part_id) JOIN nt USING (license)
), near AS (SELECT doc_id, license, max(dice) AS dice, count(*) AS n FROM d WHERE dice >= 0.8 GROUP BY ALL
), docs AS (
  SELECT doc_id, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS bs FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents WHERE text IS NOT NULL)
), tl AS (
  SELECT license, len(ws) - 1 AS size, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS ts FROM t
), may AS (
  SELECT doc_id, license, bs, size, ts FROM docs JOIN tl ON len(bs) >= size AND 3 * len(list_intersect(list_distinct(bs), ts)) >= 2 * len(ts)
), win AS (
  SELECT doc_id, license, list_distinct(bs[i:i + size - 1]) AS x, ts FROM (SELECT *, unnest(range(1, len(bs) - size + 2)) AS i FROM may)
), slid AS (
  SELECT doc_id, license, max(dice) AS dice, count(*) AS n FROM (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(x, ts)) / (len(x) + len(ts)) AS dice FROM win) WHERE dice >= 0.8 GROUP BY ALL
)
SELECT doc_id, license, greatest(near.dice, slid.dice) AS dice, coalesce(near.n, 0)::BIGINT AS n_candidates, coalesce(slid.n, 0)::BIGINT AS n_windows
FROM near FULL JOIN slid USING (doc_id, license)
""",
    "op12_lexical_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL
), s AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0
), p AS (SELECT doc_id, w, n, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM d) GROUP BY ALL
), q AS (
  SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL
), df AS (SELECT w, count(*) AS df FROM p WHERE w IN (SELECT w FROM q) GROUP BY w
), weights AS (SELECT w, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM df, s
), scored AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN p USING (w) JOIN weights USING (w), s GROUP BY item_id, doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op13_url_filter": rf"""
WITH pages_ AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), labels_ AS (
  SELECT doc_id AS page_id, max(((toxic = 1) OR (quality = 0))::BIGINT) AS bad FROM labels GROUP BY doc_id
), named AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS y, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS ls FROM pages_ LEFT JOIN labels_ USING (page_id) GROUP BY host
), hosts AS (
  SELECT host, n, y, CASE WHEN array_to_string(ls, '.') SIMILAR TO '[0-9.]+|\[.*' THEN 0 WHEN array_to_string(ls[-2:], '.') IN ({_SUFFIXES}) THEN 2 ELSE 1 END AS size, ls FROM named
), h AS (
  SELECT host, n, y, CASE WHEN size = 0 THEN array_to_string(ls, '.') ELSE array_to_string(ls[-size - 1:], '.') END AS domain, CASE WHEN size = 0 THEN '' ELSE array_to_string(ls[-size:], '.') END AS suffix FROM hosts
), d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y FROM d GROUP BY ALL
), t AS (SELECT CASE WHEN sum(n) > 0 THEN sum(y)::DOUBLE / sum(n) ELSE 0 END AS rate FROM s
), of_suffix AS {_level("s", "t", "ON TRUE", "rate", "c.suffix")}
, of_domain AS {_level("d", "of_suffix", "USING (suffix)", "rate", "c.domain, c.suffix")}
, of_host AS {_level("h", "of_domain", "USING (domain, suffix)", "rate", "c.host")}
, rules AS (SELECT * FROM (VALUES {_RULES}) AS r(rule, verdict, site, start)
), fits AS (
  SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) AS r
  FROM (SELECT DISTINCT * FROM pages_) JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN rate - {url_filter.Z}::DOUBLE * sqrt(rate * (1 - rate) / (weight + 1)) > {url_filter.LIMIT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       n AS n_labels, y AS n_bad, round(rate - {url_filter.Z}::DOUBLE * sqrt(rate * (1 - rate) / (weight + 1)), 6) AS bound
FROM pages_ AS p JOIN of_host USING (host) LEFT JOIN (SELECT * FROM fits WHERE r = 1) AS f ON p.page_id = f.page_id AND p.host = f.host AND p.path = f.path
""",
}
