"""SQL, for DuckDB, of the operators that SQL can express over a small table: other ways to the same rows."""

from __future__ import annotations

from lodestone.llm.redirects import RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d CROSS JOIN k WHERE len(w) >= k),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n::BIGINT AS n_shingles, n_found::BIGINT AS n_found, n_found::DOUBLE / n AS containment FROM f JOIN n USING (item_id) WHERE n_found * 10 >= n * 8
"""


def _fit(out: int) -> str:
    """A CASE over the rules, longest first: the rule (0) or its verdict (1)."""
    cases = []
    for verdict, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{(host + path, verdict)[out]}'")
    return f"CASE {' '.join(cases)} END"


def _parts(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract({rest}, '^[^/?#]*[^?#]*(\\?[^#]*)?', 1) AS query"


_REST = "CASE WHEN strpos(coalesce({0}, ''), '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"

OP3 = f"""
WITH RECURSIVE p AS (SELECT page_id, html, {_parts(_REST.format('url'))} FROM pages),
page AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN host || path || query END AS node,
  regexp_extract(regexp_extract(coalesce(html, ''), '(?i)<link\\b[^>]*\\brel=["'']?canonical\\b[^>]*>'), '(?i)\\bhref=["'']?([^"''\\s>]+)', 1) AS aim FROM p),
t AS (SELECT node, host || path || query AS "to", host, path FROM (SELECT node, {_parts(_REST.format('aim'))} FROM page WHERE node IS NOT NULL AND aim LIKE '%://%')),
e AS (SELECT node AS a, node AS b FROM page WHERE node IS NOT NULL UNION SELECT node, "to" FROM t),
near AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
walk AS (SELECT a, b FROM near UNION SELECT w.a, n.b FROM walk w JOIN near n ON w.b = n.a),
comp AS (SELECT a AS node, min(b) AS component FROM walk GROUP BY 1),
seen AS (SELECT node, host, path FROM page WHERE node IS NOT NULL UNION SELECT "to", host, path FROM t),
told AS (SELECT component, min({_fit(1)}) AS inherited FROM seen JOIN comp USING (node) GROUP BY 1)
SELECT page_id, host, path, {_fit(0)} AS rule, coalesce({_fit(1)}, inherited, 'allow') AS verdict,
  CASE WHEN {_fit(1)} IS NOT NULL THEN 'rule' WHEN inherited IS NOT NULL THEN 'alias' ELSE 'default' END AS "by", component
FROM page LEFT JOIN comp USING (node) LEFT JOIN told USING (component)
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b USING (g) WHERE a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
near AS (SELECT a, b FROM c UNION SELECT b, a FROM c),
walk AS (SELECT a, b FROM near UNION SELECT walk.a, near.b FROM walk JOIN near ON walk.b = near.a),
comp AS (SELECT a, min(b) AS b FROM walk GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM s LEFT JOIN comp ON a = doc_id
"""

OP9 = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY p) AS l, count(*)::BIGINT AS n, string_agg('<|im_start|>' || regexp_replace(replace(coalesce(role, 'user'), '<|', '<' || chr(92) || '|'), '[\\r\\n]+', ' ', 'g') || chr(10) || replace(coalesce(text, ''), '<|', '<' || chr(92) || '|') || '<|im_end|>', chr(10) ORDER BY p) AS chat FROM t GROUP BY 1),
inner_ AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
first_ AS (SELECT min(conv_id) AS conv_id FROM c WHERE l NOT IN (SELECT l FROM inner_) GROUP BY l)
SELECT conv_id, n AS n_turns, chat FROM c WHERE conv_id IN (SELECT conv_id FROM first_)
"""


def by_query() -> dict[str, str]:
    return {"op1_benchmark_decontamination": OP1, "op3_redirect_equivalence": OP3, "op6_ngram_jaccard_join": OP6, "op9_chat_snapshots": OP9}
