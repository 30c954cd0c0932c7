"""The registered queries over the driver's tables, with the SQL that must give the same rows.

A query is a function that calls generic operators on the relations of lodestone.plans.relations; @sql gives its oracle."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.api import Engine
from lodestone.functions import line_source
from lodestone.operators import algorithms, graph, history, issues, text
from lodestone.plans import codegraph
from lodestone.plans import relations as rel
from lodestone.sources import repository

AS_OF = date(2025, 1, 1)
_found, _sql = {}, {}

# Common table expressions of the oracles.
WITH = {
    "calls": "SELECT o_custkey AS c, l_suppkey AS s, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "pairs": "SELECT a.n_name AS src, b.n_name AS dst, sum(n)::BIGINT AS n FROM calls JOIN customer ON c_custkey = c JOIN supplier ON s_suppkey = s JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2",
    "imports": "SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM pairs) WHERE r <= 2",
    "modgraph": "SELECT src, dst, (CASE WHEN imports.src IS NULL THEN 0 ELSE 1 END)::BIGINT AS import_count, n AS call_count FROM pairs LEFT JOIN imports USING (src, dst)",
    "touched": "SELECT DISTINCT l_orderkey AS sha, p_brand AS path FROM lineitem JOIN part ON l_partkey = p_partkey",
    "blame": "SELECT p_brand AS path, s_name AS author, min(lower(s_name) || '@example.org') AS email, sum(l_quantity)::BIGINT AS lines FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "owners": "SELECT path, author, percentage FROM (SELECT path, author, round(lines * 100.0::DOUBLE / sum(lines) OVER (PARTITION BY path), 6) AS percentage, row_number() OVER (PARTITION BY path ORDER BY lines DESC, author) AS r FROM blame) WHERE r = 1",
    "freq": "SELECT path, least(count(*), 500)::BIGINT AS frequency FROM touched GROUP BY 1",
    "ages": "SELECT path, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM touched JOIN orders ON sha = o_orderkey GROUP BY 1",
    "together": "SELECT x.path, y.path AS other, count(*)::BIGINT AS together, total FROM touched x JOIN touched y USING (sha) JOIN (SELECT path, count(*) AS total FROM touched GROUP BY 1) t ON t.path = x.path WHERE x.path <> y.path GROUP BY 1, 2, 4",
    "cochange": "SELECT * FROM (SELECT path, other, together, round(together * 100.0::DOUBLE / total, 6) AS percentage, row_number() OVER (PARTITION BY path ORDER BY together DESC, other)::BIGINT AS rank FROM together WHERE together >= 3 AND together * 100.0 >= 15.0 * total) WHERE rank <= 5",
    "spans": "SELECT n_name AS path, sum(n)::BIGINT AS span FROM calls JOIN supplier ON s_suppkey = s JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "shares": "SELECT src, dst, (import_count + call_count)::DOUBLE / sum(import_count + call_count) OVER (PARTITION BY src) AS share FROM modgraph",
    "ranks": "SELECT 0 AS k, n_name AS id, 1.0::DOUBLE / (SELECT count(*) FROM nation) AS score FROM nation UNION ALL (SELECT k + 1, id, 0.15::DOUBLE / (SELECT count(*) FROM nation) + 0.85::DOUBLE * (given + lost / (SELECT count(*) FROM nation)) FROM (SELECT any_value(r.k) AS k, n.n_name AS id, coalesce(sum(CASE WHEN s.dst = n.n_name THEN r.score * s.share END), 0.0) AS given, (SELECT coalesce(sum(score), 0.0) FROM ranks d WHERE d.id NOT IN (SELECT src FROM shares)) AS lost FROM nation n CROSS JOIN ranks r LEFT JOIN shares s ON s.src = r.id AND s.dst = n.n_name GROUP BY n.n_name) WHERE k < 20)",
    "gsupp": "SELECT n_nationkey AS b, c, s FROM calls JOIN supplier ON s_suppkey = s JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_custkey = c WHERE c_nationkey <> s_nationkey",
    "gcust": "SELECT c_nationkey AS a, c, s FROM calls JOIN customer ON c_custkey = c JOIN supplier ON s_suppkey = s WHERE c_nationkey <> s_nationkey",
    "sparse": "SELECT src, dst, 1.0::DOUBLE / (import_count + call_count) AS distance FROM modgraph WHERE import_count > 0",
    "roads": "SELECT src AS s, dst AS t, [src, dst] AS path, distance AS d FROM sparse UNION ALL SELECT s, dst, list_append(path, dst), d + distance FROM roads JOIN sparse ON src = t WHERE NOT list_contains(path, dst)",
    "shortest": "SELECT r.s, r.t, path, count(*) OVER (PARTITION BY r.s, r.t) AS n FROM roads r JOIN (SELECT s, t, min(d) AS d FROM roads GROUP BY 1, 2) m ON r.s = m.s AND r.t = m.t AND r.d = m.d",
    "between": "SELECT n_name AS id, round(coalesce(part, 0.0) / ((SELECT count(*) FROM nation) - 1) / ((SELECT count(*) FROM nation) - 2), 6) AS score FROM nation LEFT JOIN (SELECT v, sum(1.0::DOUBLE / n) AS part FROM (SELECT n, unnest(path[2:-2]) AS v FROM shortest) GROUP BY 1) ON v = n_name",
    "walks": "SELECT [src] AS path, dst AS next FROM imports WHERE dst >= src UNION ALL SELECT list_append(path, next), dst FROM walks JOIN imports ON src = next WHERE len(path) < 10 AND next > path[1] AND NOT list_contains(path, next)",
    "rings": "SELECT path, length FROM (SELECT path, length, row_number() OVER (ORDER BY length, path) AS r FROM (SELECT path, len(path)::BIGINT AS length FROM walks WHERE next = path[1])) WHERE r <= 100",
    "places": "SELECT n_nationkey AS k, n_name, 'pkg/' || lower(n_name) || '.py' AS file FROM nation",
    "brought": "SELECT a.file AS src, b.file AS dst, row_number() OVER (PARTITION BY a.file ORDER BY imports.dst) AS line FROM imports JOIN places a ON a.n_name = imports.src JOIN places b ON b.n_name = imports.dst",
    "sold": "SELECT s_suppkey AS s, file, coalesce(i, 0) + 2 * row_number() OVER (PARTITION BY file ORDER BY s_suppkey) - 1 AS line FROM supplier JOIN places ON s_nationkey = k LEFT JOIN (SELECT src, count(*) AS i FROM brought GROUP BY 1) ON src = file",
    "blocks": "SELECT c, file, m, coalesce(i, 0) + 2 * coalesce(u, 0) + 1 + coalesce(sum(m + 1) OVER (PARTITION BY file ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM (SELECT c, count(*) AS m FROM calls GROUP BY 1) JOIN customer ON c = c_custkey JOIN places ON c_nationkey = k LEFT JOIN (SELECT src, count(*) AS i FROM brought GROUP BY 1) ON src = file LEFT JOIN (SELECT file AS f, count(*) AS u FROM sold GROUP BY 1) ON f = file",
    "said": "SELECT blocks.file || '::customer_' || c AS src, sold.file || '::supplier_' || s AS dst, blocks.file AS a, sold.file AS b, blocks.line + row_number() OVER (PARTITION BY c ORDER BY s) AS line FROM calls JOIN blocks USING (c) JOIN sold USING (s)",
    "meant": "SELECT said.* FROM said LEFT JOIN brought ON brought.src = a AND brought.dst = b WHERE a = b OR brought.src IS NOT NULL",
    "entities": "SELECT file || '::supplier_' || s AS id, 'function' AS type, file, 'supplier_' || s AS name, 2 AS span, line FROM sold UNION ALL SELECT file || '::customer_' || c, 'function', file, 'customer_' || c, m + 1, line FROM blocks",
    "idle": "SELECT id, file, name FROM entities WHERE id NOT IN (SELECT dst FROM meant)",
    "srcgraph": "SELECT a AS src, b AS dst, count(*) AS n FROM meant WHERE a <> b GROUP BY 1, 2",
    "srcedges": "SELECT src, dst, 1 + coalesce(n, 0) AS weight FROM brought LEFT JOIN srcgraph USING (src, dst)",
    "srcroads": "SELECT src AS s, dst AS t, [src, dst] AS path, 1.0::DOUBLE / weight AS d FROM srcedges UNION ALL SELECT s, dst, list_append(path, dst), d + 1.0::DOUBLE / weight FROM srcroads JOIN srcedges ON src = t WHERE NOT list_contains(path, dst)",
    "srcshort": "SELECT r.s, r.t, path, count(*) OVER (PARTITION BY r.s, r.t) AS n FROM srcroads r JOIN (SELECT s, t, min(d) AS d FROM srcroads GROUP BY 1, 2) m ON r.s = m.s AND r.t = m.t AND r.d = m.d",
    "srcbetween": "SELECT v AS id, round(sum(1.0::DOUBLE / n) / ((SELECT count(*) FROM nation) - 1) / ((SELECT count(*) FROM nation) - 2), 6) AS score FROM (SELECT n, unnest(path[2:-2]) AS v FROM srcshort) GROUP BY 1",
    "srcwalks": "SELECT [src] AS path, dst AS next FROM brought WHERE dst >= src UNION ALL SELECT list_append(path, next), dst FROM srcwalks JOIN brought ON src = next WHERE len(path) < 10 AND next > path[1] AND NOT list_contains(path, next)",
    "srcrings": "SELECT path FROM srcwalks WHERE next = path[1] ORDER BY len(path), path LIMIT 100",
    "srccoupled": "SELECT least(src, dst) || ' <-> ' || greatest(src, dst) AS pair, sum(weight)::BIGINT AS score FROM srcedges GROUP BY 1",
    "srcissues": "SELECT 'circular_dependency' AS type, 'high' AS severity, array_to_string(list_append(path, path[1]), ' → ') AS subject, 'Circular dependency: ' || array_to_string(list_append(path, path[1]), ' → ') AS description, len(path) AS n_files, 0 AS s, 0 AS o FROM srcrings UNION ALL SELECT 'dead_code', CASE WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END, file, count(*) || ' declaration(s) in ' || file || ' that nothing seems to use: ' || string_agg(name, ', ' ORDER BY name), 1, CASE WHEN count(*) >= 3 THEN 1 ELSE 2 END, 1 FROM idle GROUP BY file UNION ALL SELECT 'bottleneck', CASE WHEN score > 0.3 THEN 'high' ELSE 'medium' END, id, 'Many paths lead through ' || id || ': betweenness ' || printf('%.3f', score), 1, CASE WHEN score > 0.3 THEN 0 ELSE 1 END, 3 FROM (SELECT * FROM srcbetween ORDER BY score DESC, id LIMIT 5) WHERE score > 0.1 UNION ALL SELECT 'orphan_file', 'low', 'orphans', max(r) || ' file(s) that no other file imports: ' || string_agg(file, ', ' ORDER BY file) FILTER (r <= 10) || CASE WHEN max(r) > 10 THEN ', and ' || (max(r) - 10) || ' more' ELSE '' END, least(max(r), 10), 2, 4 FROM (SELECT file, row_number() OVER (ORDER BY file) AS r FROM places WHERE file NOT IN (SELECT dst FROM brought)) HAVING count(*) > 0 UNION ALL SELECT 'high_coupling', CASE WHEN score > 10 THEN 'high' ELSE 'medium' END, pair, pair || ' refer to each other ' || score || ' times', 2, CASE WHEN score > 10 THEN 0 ELSE 1 END, 5 FROM (SELECT * FROM srccoupled ORDER BY score DESC, pair LIMIT 10) WHERE score > 5",
    "orphaned": "SELECT n_name FROM nation WHERE n_name NOT IN (SELECT dst FROM imports)",
    "paths": "SELECT DISTINCT regexp_extract(url, '://[^/]*/([a-z]+)', 1) || '/' || regexp_extract(url, '://(?:m\\.|www\\.|blog\\.)?([^./]+)', 1) || '.py' AS path FROM pages",
    "hrefs": "SELECT DISTINCT page_id, ltrim(target, '/') AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) WHERE ltrim(target, '/') <> ''",
    "plain": "SELECT path, regexp_replace(path, '\\.[^./]*$', '') AS p FROM paths",
    "alias": "SELECT alias, path, max(exact) AS exact FROM (SELECT path, p AS alias, 1 AS exact FROM plain UNION ALL SELECT path, replace(p, '/', '.'), 1 FROM plain UNION ALL SELECT path, regexp_extract(p, '[^/]*$', 0), 0 FROM plain UNION ALL SELECT path, CASE WHEN starts_with(p, 'src/') THEN p[5:] ELSE 'src/' || p END, 0 FROM plain UNION ALL SELECT path, replace(CASE WHEN starts_with(p, 'src/') THEN p[5:] ELSE 'src/' || p END, '/', '.'), 0 FROM plain) WHERE alias <> '' GROUP BY 1, 2",
    "suffixes": "SELECT DISTINCT t.target, p AS owner FROM (SELECT DISTINCT target FROM hrefs) t JOIN plain ON suffix(p, t.target)",
    "stage": "SELECT target, alias.path AS owner, 0 AS k FROM (SELECT DISTINCT target FROM hrefs) JOIN alias ON alias = target UNION ALL SELECT target, owner, 1 FROM suffixes",
    "decided": "SELECT target, arg_min(n, k) AS n, min(k) AS k, arg_min(owner, k) AS owner FROM (SELECT target, k, count(DISTINCT owner) AS n, min(owner) AS owner FROM stage GROUP BY 1, 2) GROUP BY 1",
    "answers": "SELECT page_id, target, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' WHEN k = 0 THEN 'exact' ELSE 'inferred' END AS status FROM hrefs LEFT JOIN decided USING (target)",
    "fans": "SELECT s_nationkey, s, c, n FROM calls JOIN supplier ON s_suppkey = s",
    "gods": "SELECT n_name AS cls, coalesce(x, 0)::BIGINT AS callers, coalesce(y, 0)::BIGINT AS dependencies, (coalesce(x, 0) + coalesce(y, 0))::BIGINT AS total FROM nation LEFT JOIN (SELECT b, count(DISTINCT c) AS x FROM gsupp GROUP BY 1) ON b = n_nationkey LEFT JOIN (SELECT a, count(DISTINCT s) AS y FROM gcust GROUP BY 1) ON a = n_nationkey",
    "coupled": "SELECT least(src, dst) || ' <-> ' || greatest(src, dst) AS pair, sum(n)::BIGINT AS score FROM pairs GROUP BY 1",
    "unused": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
}
_USES = {name: [other for other in WITH if other != name and f" {other} " in f" {body.replace('(', ' ').replace(')', ' ').replace(',', ' ').replace('.', ' ')} "] for name, body in WITH.items()}


def _needed(names, have=()):
    out = list(have)
    for n in names:
        for x in (*_needed(_USES[n], out), n):
            if x not in out:
                out.append(x)
    return out


def sql(query: str, *uses: str):
    """Register a query with its oracle; `uses` names the expressions of WITH that the oracle selects from."""
    body = ", ".join(f"{n} AS ({WITH[n]})" for n in _needed(uses))

    def keep(f):
        _found[f.__name__] = f
        _sql[f.__name__] = f"WITH RECURSIVE {body} {query}" if body else query
        return f

    return keep


def rows_only(f):
    _found[f.__name__] = f
    return f


def queries() -> dict:
    return dict(_found)


def oracle_sql() -> dict:
    return dict(_sql)


# Sources, scans and text


@sql("SELECT doc_id, f || '/' || source || '_' || doc_id || e AS file_path, l AS language FROM (SELECT doc_id, source, n_chars, ['node_modules/a', 'lib.egg-info', 'src/core', 'app', 'dist', 'app/deep/er', 'web'][doc_id % 7 + 1] AS f, ['.py', '.JS', '.md', '.go', '.tsx', '.lock', '.java', '', '.kt', '.tar.rs', '.PYC'][doc_id % 11 + 1] AS e, ['python', 'javascript', NULL, 'go', 'typescript', NULL, 'java', NULL, 'kt', 'rs', NULL][doc_id % 11 + 1] AS l FROM documents) WHERE l IS NOT NULL AND doc_id % 7 NOT IN (0, 1, 4) AND n_chars * 100 <= 500000")
def scan_filter(spark, sf_dir) -> DataFrame:
    return repository.wanted(rel.listing(spark, sf_dir)).select("doc_id", "file_path", "language")


@sql("SELECT 'parts/p' || p_partkey || '.' || l AS file_path, line_no::BIGINT AS line_no, kind, name FROM (SELECT p_partkey, ['go', 'java', 'rs'][p_partkey % 3 + 1] AS l, unnest([{'line_no': 1, 'kind': 'import', 'name': CASE WHEN p_partkey % 3 < 2 THEN 'lib/p' || p_size ELSE '\"lib/p' || p_size || '\"' END}, {'line_no': 2, 'kind': CASE WHEN p_partkey % 3 = 2 THEN 'import' END, 'name': 'pkg' || p_size}, {'line_no': 3, 'kind': 'function', 'name': 'make_' || p_partkey}, {'line_no': 6, 'kind': 'class', 'name': 'Part' || p_partkey}, {'line_no': 7, 'kind': 'function', 'name': 'price_' || p_partkey}], recursive := true) FROM part) WHERE kind IS NOT NULL")
def line_rules(spark, sf_dir) -> DataFrame:
    return line_source.found(rel.declarations(spark, sf_dir))


@sql("SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents")
def line_profile(spark, sf_dir) -> DataFrame:
    return rel.table(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).alias("n_lines"))


RULES = [("shout", "^([A-Z]+)!!"), ("table", "([A-Za-z]+) \\| "), ("number", "([0-9][0-9][0-9]+)")]


@sql("SELECT id, line_no, kind, name FROM (SELECT id, line_no, CASE WHEN regexp_matches(line, '^([A-Z]+)!!') THEN 'shout' WHEN regexp_matches(line, '([A-Za-z]+) \\| ') THEN 'table' WHEN regexp_matches(line, '([0-9][0-9][0-9]+)') THEN 'number' END AS kind, CASE WHEN regexp_matches(line, '^([A-Z]+)!!') THEN regexp_extract(line, '^([A-Z]+)!!', 1) WHEN regexp_matches(line, '([A-Za-z]+) \\| ') THEN regexp_extract(line, '([A-Za-z]+) \\| ', 1) ELSE regexp_extract(line, '([0-9][0-9][0-9]+)', 1) END AS name FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no FROM documents)) WHERE kind IS NOT NULL")
def regex_inventory(spark, sf_dir) -> DataFrame:
    return text.inventory(text.lines(rel.table(spark, sf_dir, "documents"), "doc_id", "text"), RULES)


def _targets(spark, sf_dir) -> DataFrame:
    found = text.links(rel.table(spark, sf_dir, "pages"), "page_id", "html")
    return found.select(F.col("id").alias("request"), F.regexp_replace("target", "^/+", "").alias("target")).where("target <> ''").distinct()


def _files(spark, sf_dir) -> DataFrame:
    path = F.concat(F.regexp_extract("url", "://[^/]*/([a-z]+)", 1), F.lit("/"), F.regexp_extract("url", "://(?:m\\.|www\\.|blog\\.)?([^./]+)", 1), F.lit(".py"))
    return rel.table(spark, sf_dir, "pages").select(path.alias("file_path")).distinct()


@sql("SELECT page_id, target FROM hrefs", "hrefs")
def import_parse(spark, sf_dir) -> DataFrame:
    return _targets(spark, sf_dir).withColumnRenamed("request", "page_id")


@sql("SELECT alias, path AS file_path, exact = 1 AS exact, count(*) OVER (PARTITION BY alias)::BIGINT AS n_owners FROM alias", "alias")
def module_aliases(spark, sf_dir) -> DataFrame:
    return text.aliases(_files(spark, sf_dir)).select("alias", "file_path", "exact", "n_owners")


def _suffixes(spark, sf_dir) -> DataFrame:
    names = _files(spark, sf_dir).select(F.regexp_replace("file_path", "\\.[^./]*$", "").alias("name")).distinct()
    return text.ends_with(_targets(spark, sf_dir).select("target"), names)


@sql("SELECT target, owner AS name FROM suffixes", "suffixes")
def suffix_join(spark, sf_dir) -> DataFrame:
    return _suffixes(spark, sf_dir).select("target", "name")


def _resolved(spark, sf_dir) -> DataFrame:
    exact = text.aliases(_files(spark, sf_dir)).select(F.col("alias").alias("target"), F.col("file_path").alias("owner"))
    return text.cascade(_targets(spark, sf_dir), [("exact", exact), ("inferred", _suffixes(spark, sf_dir).withColumnRenamed("name", "owner"))])


@sql("SELECT page_id, target, status FROM answers", "answers")
def resolve_cascade(spark, sf_dir) -> DataFrame:
    return _resolved(spark, sf_dir).select(F.col("request").alias("page_id"), "target", "status")


@sql("SELECT count(*)::BIGINT AS ambiguous FROM answers WHERE status = 'ambiguous'", "answers")
def ambiguous_keys(spark, sf_dir) -> DataFrame:
    return _resolved(spark, sf_dir).where("status = 'ambiguous'").agg(F.count("*").alias("ambiguous"))


@sql("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT c FROM calls)", "calls")
def semi_callers(spark, sf_dir) -> DataFrame:
    known = rel.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"))
    return graph.known_callers(known, rel.calls(spark, sf_dir).select(F.col("c").alias("id"))).select(F.col("src").alias("c_custkey"))


@sql("SELECT src, dst, sum(n)::BIGINT AS \"count\", CASE WHEN min(e) = 1 THEN 'exact' ELSE 'inferred' END AS resolution, string_agg(line, ',' ORDER BY seq, line) FILTER (r <= 20) AS source_lines FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY seq, line) AS r FROM (SELECT o_custkey AS src, l_suppkey AS dst, (l_quantity::INT)::VARCHAR AS line, min(l_orderkey * 8 + l_linenumber) AS seq, count(*) AS n, min(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)) GROUP BY 1, 2")
def edge_accumulate(spark, sf_dir) -> DataFrame:
    lines = rel.table(spark, sf_dir, "lineitem").join(rel.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    resolution = F.when(F.col("l_returnflag") == "N", "exact").otherwise("inferred")
    observed = lines.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("calls").alias("type"), resolution.alias("resolution"), F.col("l_quantity").cast("int").cast("string").alias("line"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return graph.accumulate(observed).select("src", "dst", "count", "resolution", F.array_join("source_lines", ",").alias("source_lines"))


# Lookups and counts


@sql("SELECT p_partkey AS id, p_name AS name, (CASE WHEN lower(p_name) = 'al' THEN 0 WHEN contains(lower(p_name), 'al') THEN 1 ELSE 2 END)::BIGINT AS relevance FROM part WHERE contains(lower(p_name), 'al') OR contains(lower(p_type), 'al') ORDER BY 3, lower(p_name), p_type, 1 LIMIT 20")
def search_entities(spark, sf_dir) -> DataFrame:
    nodes = rel.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("file_path"), F.lit("function").alias("type"))
    return graph.search(nodes, "AL", "function").select("id", "name", "relevance")


@sql("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE regexp_matches(event_type, '^(main$|app$|cli$|__main__$|test_|conftest$|(get|post|put|delete|patch)(_|[A-Z]|$)|handle(_|[A-Z]|$)|on_|setup$|teardown$|index$|route_|view|click)') GROUP BY 1")
def entry_point_filter(spark, sf_dir) -> DataFrame:
    own = graph.is_entry_point(F.col("event_type")) | F.col("event_type").rlike("^(view|click)")
    return graph.counts_by(rel.table(spark, sf_dir, "events").where(own), "event_type")


@sql("SELECT 'module' AS type, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'function', count(*) FROM customer UNION ALL SELECT 'class', count(*) FROM supplier")
def entity_counts(spark, sf_dir) -> DataFrame:
    kinds = [("module", "nation"), ("function", "customer"), ("class", "supplier")]
    return graph.counts_by(reduce(DataFrame.unionByName, [rel.table(spark, sf_dir, t).select(F.lit(k).alias("type")) for k, t in kinds]), "type")


@sql("SELECT 'calls' AS type, sum(n)::BIGINT AS n FROM calls UNION ALL SELECT 'imports', count(*)::BIGINT FROM imports", "calls", "imports")
def edge_counts(spark, sf_dir) -> DataFrame:
    edges = rel.call_edges(spark, sf_dir).unionByName(rel.nation_imports(spark, sf_dir))
    return graph.counts_by(edges, "type", "count")


@sql("SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def language_counts(spark, sf_dir) -> DataFrame:
    return graph.counts_by(rel.table(spark, sf_dir, "documents"), "lang")


@sql("SELECT count(*)::BIGINT AS observed, sum((status IN ('exact', 'inferred'))::INT)::BIGINT AS resolved, sum((status = 'ambiguous')::INT)::BIGINT AS ambiguous, sum((status = 'unresolved')::INT)::BIGINT AS unresolved FROM answers", "answers")
def coverage_counts(spark, sf_dir) -> DataFrame:
    n = lambda *s: F.sum(F.col("status").isin(*s).cast("int")).cast("long")
    return _resolved(spark, sf_dir).agg(F.count("*").alias("observed"), n("exact", "inferred").alias("resolved"), n("ambiguous").alias("ambiguous"), n("unresolved").alias("unresolved"))


@sql("SELECT (SELECT count(*) FROM rings)::BIGINT AS cycles, (SELECT count(*) FROM (SELECT * FROM between ORDER BY score DESC, id LIMIT 5) WHERE score > 0.005)::BIGINT AS bottlenecks, (SELECT count(*) FROM orphaned)::BIGINT AS orphans, (SELECT count(*) FROM unused)::BIGINT AS dead, (SELECT count(*) FROM gods WHERE total > 10)::BIGINT AS god_classes, (SELECT round(avg(span), 6) FROM spans) AS avg_span", "orphaned", "unused", "gods", "spans", "rings", "between")
def health_summary(spark, sf_dir) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(algorithms.cycles(_sparse(spark, sf_dir)), "cycles"), one(bottlenecks(spark, sf_dir), "bottlenecks"), one(_orphans(spark, sf_dir), "orphans"), one(_dead(spark, sf_dir), "dead"), one(_gods(spark, sf_dir), "god_classes")]
    return reduce(lambda a, b: a.join(F.broadcast(b)), [*parts, _spans(spark, sf_dir).agg(F.round(F.avg("span"), 6).alias("avg_span"))])  # one row each


# Projections and rankings


def _module_graph(spark, sf_dir) -> DataFrame:
    both = rel.nation_calls(spark, sf_dir).unionByName(rel.nation_imports(spark, sf_dir))
    home = rel.modules(spark, sf_dir).select("id", "file_path")
    return graph.module_graph(both, home)


@sql("SELECT src, dst, import_count, call_count, import_count + call_count AS weight, round(1.0::DOUBLE / (import_count + call_count), 9) AS distance FROM modgraph", "modgraph")
def module_graph(spark, sf_dir) -> DataFrame:
    return _module_graph(spark, sf_dir).withColumn("distance", F.round("distance", 9))


def _spans(spark, sf_dir) -> DataFrame:
    homes = rel.homes(spark, sf_dir)
    return rel.call_edges(spark, sf_dir).join(homes, F.col("dst") == F.col("id")).groupBy(F.col("file_path").alias("path")).agg(F.sum("count").cast("long").alias("span"))


@sql("SELECT 's' || s AS id, sum(n)::BIGINT AS score, row_number() OVER (ORDER BY sum(n) DESC, 's' || s)::BIGINT AS rank, CASE WHEN sum(n) > 50 THEN 'very large' WHEN sum(n) > 20 THEN 'large' ELSE 'moderate' END AS interpretation FROM calls GROUP BY s ORDER BY 3 LIMIT 15", "calls")
def complexity_topk(spark, sf_dir) -> DataFrame:
    spans = rel.call_edges(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.sum("count").alias("span"))
    return graph.largest(spans)


@sql("SELECT pair, score, row_number() OVER (ORDER BY score DESC, pair)::BIGINT AS rank FROM coupled ORDER BY 3 LIMIT 15", "coupled")
def coupling_topk(spark, sf_dir) -> DataFrame:
    return graph.coupling(rel.nation_calls(spark, sf_dir))


_BRANDS = "SELECT p_brand AS path, sum(p_size)::BIGINT AS span FROM part GROUP BY 1"


def _hotspots(spark, sf_dir) -> DataFrame:
    spans = rel.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path")).agg(F.sum("p_size").cast("long").alias("span"))
    return history.hotspots(rel.commits(spark, sf_dir), spans)


@sql(f"SELECT path, frequency, span, frequency * span AS score, row_number() OVER (ORDER BY frequency * span DESC, path)::BIGINT AS rank FROM freq JOIN ({_BRANDS}) USING (path) ORDER BY 5 LIMIT 15", "freq")
def hotspots(spark, sf_dir) -> DataFrame:
    return graph.top(_hotspots(spark, sf_dir), 15, F.desc("score"), F.asc("path"))


@sql(f"SELECT path, CASE WHEN r / n <= 0.2::DOUBLE THEN 'hot' WHEN r / n <= 0.5::DOUBLE THEN 'warm' WHEN r / n <= 0.8::DOUBLE THEN 'mild' ELSE 'cold' END AS band FROM (SELECT path, row_number() OVER (ORDER BY frequency * span DESC, path)::DOUBLE AS r, count(*) OVER ()::DOUBLE AS n FROM freq JOIN ({_BRANDS}) USING (path))", "freq")
def hotspot_bands(spark, sf_dir) -> DataFrame:
    return issues.bands(_hotspots(spark, sf_dir), "path", F.desc("score"), F.asc("path"))


@sql("SELECT path, author, email, lines, round(lines * 100.0::DOUBLE / sum(lines) OVER (PARTITION BY path), 6) AS percentage FROM blame", "blame")
def ownership_share(spark, sf_dir) -> DataFrame:
    return history.ownership(rel.blame(spark, sf_dir))


@sql("SELECT path, author, percentage, row_number() OVER (ORDER BY percentage DESC, path)::BIGINT AS rank FROM owners ORDER BY 4 LIMIT 15", "owners")
def ownership_topk(spark, sf_dir) -> DataFrame:
    return graph.top(history.main_owner(rel.blame(spark, sf_dir)), 15, F.desc("percentage"), F.asc("path"))


@sql("SELECT * FROM (SELECT 'pagerank' AS section, id AS item, round(score, 6) AS score FROM ranks WHERE k = 20 ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL SELECT * FROM (SELECT 'centrality', id, score FROM between ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL SELECT * FROM (SELECT 'complexity', 's' || s, sum(n)::DOUBLE FROM calls GROUP BY s ORDER BY 3 DESC, 2 LIMIT 5)", "calls", "between", "ranks")
def metric_summary(spark, sf_dir) -> DataFrame:
    spans = rel.call_edges(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.sum("count").cast("double").alias("score"))
    ranks = _pagerank(spark, sf_dir).select("id", F.round("score", 6).alias("score"))
    best = lambda name, df: df.orderBy(F.desc("score"), "id").limit(5).select(F.lit(name).alias("section"), F.col("id").alias("item"), "score")
    return best("pagerank", ranks).unionByName(best("centrality", betweenness(spark, sf_dir))).unionByName(best("complexity", spans))


# History


@sql("SELECT path, least(count(*), 2400)::BIGINT AS frequency FROM touched GROUP BY 1", "touched")
def change_frequency(spark, sf_dir) -> DataFrame:
    return history.frequency(rel.commits(spark, sf_dir), 2400)  # some brands have more commits, some fewer


@sql("SELECT path, count(*)::BIGINT AS frequency FROM touched WHERE sha IN (SELECT DISTINCT sha FROM touched ORDER BY 1 DESC LIMIT 500) GROUP BY 1", "touched")
def change_frequency_recent(spark, sf_dir) -> DataFrame:
    return history.frequency(history.recent_commits(rel.commits(spark, sf_dir)))


@sql("SELECT sha, string_agg(path, ',' ORDER BY path) AS paths, count(*)::BIGINT AS n_paths FROM touched GROUP BY 1", "touched")
def commit_files(spark, sf_dir) -> DataFrame:
    return history.commit_files(rel.commits(spark, sf_dir))


@sql("SELECT path, rank, sha, day FROM (SELECT path, row_number() OVER (PARTITION BY path ORDER BY sha DESC)::BIGINT AS rank, sha, strftime(o_orderdate, '%Y-%m-%d') AS day FROM touched JOIN orders ON o_orderkey = sha) WHERE rank <= 10", "touched")
def recent_commits(spark, sf_dir) -> DataFrame:
    return history.newest_of(rel.commits(spark, sf_dir))


@sql(f"SELECT path, strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day, greatest(DATE '{AS_OF}' - b, 0)::BIGINT AS days_since FROM ages", "ages")
def file_age(spark, sf_dir) -> DataFrame:
    return history.age(rel.commits(spark, sf_dir), AS_OF)


@sql("SELECT path, other, together, percentage, rank FROM cochange", "cochange")
def co_change(spark, sf_dir) -> DataFrame:
    return history.co_changes(rel.commits(spark, sf_dir), percent=15.0)


@sql(f"SELECT path, frequency, strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day, greatest(DATE '{AS_OF}' - b, 0)::BIGINT AS days_since, author AS owner, percentage AS owner_percentage, coalesce(partners, '') AS partners FROM freq JOIN ages USING (path) LEFT JOIN owners USING (path) LEFT JOIN (SELECT path, string_agg(other, ',' ORDER BY rank) AS partners FROM cochange GROUP BY 1) USING (path)", "freq", "ages", "owners", "cochange")
def git_context(spark, sf_dir) -> DataFrame:
    return history.context(rel.commits(spark, sf_dir), rel.blame(spark, sf_dir), AS_OF, 15.0)


# Graph algorithms


def _pagerank(spark, sf_dir) -> DataFrame:
    return algorithms.pagerank(rel.modules(spark, sf_dir).select("id"), _module_graph(spark, sf_dir).select("src", "dst", "weight"), rounds=20, tolerance=None)


@sql("SELECT id, round(score, 6) AS score FROM ranks WHERE k = 20", "ranks")
def pagerank(spark, sf_dir) -> DataFrame:
    return _pagerank(spark, sf_dir).select("id", F.round("score", 6).alias("score"))


@sql("SELECT id, round(score, 6) AS score, degree, row_number() OVER (ORDER BY round(score, 6) DESC, degree DESC, id)::BIGINT AS rank FROM ranks JOIN (SELECT x AS id, count(*)::BIGINT AS degree FROM (SELECT src AS x FROM modgraph UNION ALL SELECT dst FROM modgraph) GROUP BY 1) USING (id) WHERE k = 20 ORDER BY 4 LIMIT 10", "ranks", "modgraph")
def top_nodes(spark, sf_dir) -> DataFrame:
    edges = _module_graph(spark, sf_dir)
    degree = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    both = _pagerank(spark, sf_dir).join(degree, "id").withColumn("score", F.round("score", 6))
    return graph.top(both, 10, F.desc("score"), F.desc("degree"), F.asc("id"))


def _sparse(spark, sf_dir) -> DataFrame:
    return rel.nation_imports(spark, sf_dir).select("src", "dst")


@sql("SELECT id, score FROM between", "between")
def betweenness(spark, sf_dir) -> DataFrame:
    edges = _module_graph(spark, sf_dir).join(_sparse(spark, sf_dir), ["src", "dst"], "left_semi")
    return algorithms.betweenness(rel.modules(spark, sf_dir).select("id"), edges)


def _communities(spark, sf_dir) -> DataFrame:
    return algorithms.communities(rel.modules(spark, sf_dir).select("id"), _module_graph(spark, sf_dir).join(_sparse(spark, sf_dir), ["src", "dst"], "left_semi"))


@rows_only
def communities(spark, sf_dir) -> DataFrame:
    return _communities(spark, sf_dir)


_FOLDERS = ("src/api", "lib/models", "tools/my_kit", "services", "docs")


@sql("SELECT DISTINCT ['API Layer', 'Data/Model Layer', 'My Kit', 'Service Layer', 'Docs'][n_regionkey % 5 + 1] AS layer FROM nation")
def layers(spark, sf_dir) -> DataFrame:
    folder = F.element_at(F.array(*(F.lit(f) for f in _FOLDERS)), (F.col("n_regionkey") % 5 + 1).cast("int"))
    members = rel.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("community"), F.concat(folder, F.lit("/"), F.lower("n_name"), F.lit("/a.py")).alias("path"))
    return issues.layers(members)


@sql("SELECT array_to_string(path, ' -> ') AS path, length FROM rings", "rings")
def import_cycles(spark, sf_dir) -> DataFrame:
    return algorithms.cycles(_sparse(spark, sf_dir)).select(F.array_join("path", " -> ").alias("path"), "length")


def _with_trace(name: str, edges: str, depth: int = 5, start: str = "NATION_0") -> None:
    walk = f", near AS ({edges}), hops AS (SELECT '{start}' AS node, 0 AS depth UNION SELECT dst, hops.depth + 1 FROM hops JOIN near ON src = node WHERE hops.depth < {depth}) SELECT node, min(depth)::BIGINT AS depth FROM hops WHERE node <> '{start}' GROUP BY 1"
    _sql[name] = f"WITH RECURSIVE {', '.join(f'{n} AS ({WITH[n]})' for n in _needed(['imports']))}" + walk


@rows_only
def trace_forward(spark, sf_dir) -> DataFrame:
    return algorithms.reach(_sparse(spark, sf_dir), "NATION_0", 5)


@rows_only
def trace_backward(spark, sf_dir) -> DataFrame:
    return algorithms.reach(_sparse(spark, sf_dir), "NATION_9", 5, "backward")


@rows_only
def trace_both(spark, sf_dir) -> DataFrame:
    return algorithms.reach(_sparse(spark, sf_dir), "NATION_0", 5, "both")


_with_trace("trace_forward", "SELECT src, dst FROM imports")
_with_trace("trace_backward", "SELECT dst AS src, src AS dst FROM imports", start="NATION_9")
_with_trace("trace_both", "SELECT src, dst FROM imports UNION SELECT dst, src FROM imports")


@rows_only
def trace_truncated(spark, sf_dir) -> DataFrame:
    _, more = algorithms.trace(_sparse(spark, sf_dir), "NATION_0", 2)
    return spark.range(1).select(F.lit(more).alias("truncated"))


_sql["trace_truncated"] = f"WITH RECURSIVE {', '.join(f'{n} AS ({WITH[n]})' for n in _needed(['imports']))}" + ", near AS (SELECT src, dst FROM imports), hops AS (SELECT 'NATION_0' AS node, 0 AS depth UNION SELECT dst, hops.depth + 1 FROM hops JOIN near ON src = node WHERE hops.depth < 3), found AS (SELECT node, min(depth) AS depth FROM hops WHERE node <> 'NATION_0' GROUP BY 1) SELECT sum((depth <= 2)::INT) >= 15 OR max(depth) > 2 AS truncated FROM found"


# Rules


def _dead(spark, sf_dir) -> DataFrame:
    orders = rel.table(spark, sf_dir, "orders")
    nodes = orders.select(F.col("o_orderkey").alias("id"), F.lit("function").alias("type"), F.lit("tree").alias("source"), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("file_path"))
    return graph.dead(nodes, rel.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dst")))


@sql("SELECT o_orderkey AS id, o_orderpriority AS file_path FROM unused", "unused")
def dead_code(spark, sf_dir) -> DataFrame:
    return _dead(spark, sf_dir).select("id", "file_path")


@sql("SELECT o_orderpriority AS file_path, count(*)::BIGINT AS n, CASE WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS severity, string_agg('order' || o_orderkey, ', ' ORDER BY 'order' || o_orderkey) AS names FROM unused GROUP BY 1", "unused")
def dead_code_by_file(spark, sf_dir) -> DataFrame:
    return issues.dead_by_file(_dead(spark, sf_dir))


def _orphans(spark, sf_dir) -> DataFrame:
    return graph.orphans(rel.modules(spark, sf_dir), rel.nation_imports(spark, sf_dir))


@sql("SELECT n_name AS id FROM orphaned", "orphaned")
def orphan_files(spark, sf_dir) -> DataFrame:
    return _orphans(spark, sf_dir).select("id")


@sql("SELECT string_agg(n_name, ', ' ORDER BY n_name) FILTER (r <= 10) || CASE WHEN max(r) > 10 THEN ', and ' || (max(r) - 10) || ' more' ELSE '' END AS files, max(r)::BIGINT AS n FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS r FROM orphaned)", "orphaned")
def orphan_issue(spark, sf_dir) -> DataFrame:
    return issues.orphans(_orphans(spark, sf_dir))


def _gods(spark, sf_dir) -> DataFrame:
    homes = rel.homes(spark, sf_dir).select(F.col("file_path").alias("cls"), "id")
    return graph.god_classes(homes, rel.call_edges(spark, sf_dir))


@sql("SELECT cls, callers, dependencies, total FROM gods WHERE total > 10", "gods")
def god_class(spark, sf_dir) -> DataFrame:
    return _gods(spark, sf_dir)


@sql("SELECT id, score, CASE WHEN score > 0.3 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT * FROM between ORDER BY score DESC, id LIMIT 5) WHERE score > 0.005", "between")
def bottlenecks(spark, sf_dir) -> DataFrame:
    return issues.bottlenecks(betweenness(spark, sf_dir), over=0.005)


@sql("SELECT pair, score, CASE WHEN score > 10 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT * FROM coupled ORDER BY score DESC, pair LIMIT 10) WHERE score > 5", "coupled")
def high_coupling(spark, sf_dir) -> DataFrame:
    return issues.high_coupling(graph.coupling(rel.nation_calls(spark, sf_dir), 10))


@sql("SELECT type, severity, subject, row_number() OVER (ORDER BY s, o, subject)::BIGINT AS rank FROM (SELECT 'circular_dependency' AS type, 'high' AS severity, array_to_string(list_append(path, path[1]), ' → ') AS subject, 0 AS s, 0 AS o FROM rings UNION ALL SELECT 'dead_code' AS type, CASE WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS severity, o_orderpriority AS subject, CASE WHEN count(*) >= 3 THEN 1 ELSE 2 END AS s, 1 AS o FROM unused GROUP BY o_orderpriority UNION ALL SELECT 'god_class', CASE WHEN total > 20 THEN 'high' ELSE 'medium' END, cls, CASE WHEN total > 20 THEN 0 ELSE 1 END, 2 FROM gods WHERE total > 10 UNION ALL SELECT 'bottleneck', CASE WHEN score > 0.3 THEN 'high' ELSE 'medium' END, id, CASE WHEN score > 0.3 THEN 0 ELSE 1 END, 3 FROM (SELECT * FROM between ORDER BY score DESC, id LIMIT 5) WHERE score > 0.005 UNION ALL SELECT 'orphan_file', 'low', 'orphans', 2, 4 FROM (SELECT 1 FROM orphaned LIMIT 1) UNION ALL SELECT 'high_coupling', CASE WHEN score > 10 THEN 'high' ELSE 'medium' END, pair, CASE WHEN score > 10 THEN 0 ELSE 1 END, 5 FROM (SELECT * FROM coupled ORDER BY score DESC, pair LIMIT 10) WHERE score > 5) ORDER BY 4 LIMIT 60", "unused", "gods", "orphaned", "coupled", "between", "rings")
def issues_all(spark, sf_dir) -> DataFrame:
    rules = {
        "circular_dependency": lambda: algorithms.cycles(_sparse(spark, sf_dir)), "dead_code": lambda: issues.dead_by_file(_dead(spark, sf_dir)), "god_class": lambda: issues.god_severity(_gods(spark, sf_dir)),
        "bottleneck": lambda: bottlenecks(spark, sf_dir), "orphan_file": lambda: issues.orphans(_orphans(spark, sf_dir)), "high_coupling": lambda: issues.high_coupling(graph.coupling(rel.nation_calls(spark, sf_dir), 10)),
    }
    return issues.detected(spark, rules, 60).select("type", "severity", "subject", "rank")


# The whole code path: files are parsed, resolved and analysed


def _engine(spark, sf_dir) -> Engine:
    return Engine(spark, "", codegraph.build(repository.parsed(rel.sources(spark, sf_dir))), repository.Limits())


@sql("SELECT id, type, span::INT AS span, line::INT AS line_start FROM entities UNION ALL SELECT file, 'module', greatest(1, coalesce(i, 0) + 2 * coalesce(u, 0) + coalesce(b, 0))::INT, 1 FROM places LEFT JOIN (SELECT src, count(*) AS i FROM brought GROUP BY 1) x ON x.src = file LEFT JOIN (SELECT file AS f, count(*) AS u FROM sold GROUP BY 1) y ON y.f = file LEFT JOIN (SELECT file AS g, sum(m + 1) AS b FROM blocks GROUP BY 1) z ON z.g = file", "entities", "brought", "sold", "blocks", "places")
def source_nodes(spark, sf_dir) -> DataFrame:
    return _engine(spark, sf_dir).code.nodes.select("id", "type", "span", "line_start")


@sql("SELECT src, dst, 1::BIGINT AS \"count\", 'exact' AS resolution FROM brought", "brought")
def source_imports(spark, sf_dir) -> DataFrame:
    return _engine(spark, sf_dir).code.edges.where("type = 'imports'").select("src", "dst", "count", "resolution")


@sql("SELECT src, dst, 1::BIGINT AS \"count\", 'exact' AS resolution, line::INT AS line FROM meant", "meant")
def source_calls(spark, sf_dir) -> DataFrame:
    return _engine(spark, sf_dir).code.edges.where("type = 'calls'").select("src", "dst", "count", "resolution", F.col("source_lines")[0].alias("line"))


@sql("SELECT (SELECT count(*) FROM said)::BIGINT AS calls_observed, (SELECT count(*) FROM meant)::BIGINT AS calls_resolved, (SELECT count(*) FROM said)::BIGINT - (SELECT count(*) FROM meant)::BIGINT AS calls_unresolved, 0::BIGINT AS calls_ambiguous, (SELECT count(*) FROM nation)::BIGINT AS files, (SELECT count(*) FROM nation)::BIGINT AS tree_files, 0::BIGINT AS imports_ambiguous", "said", "meant")
def source_coverage(spark, sf_dir) -> DataFrame:
    return _engine(spark, sf_dir).code.coverage.select("calls_observed", "calls_resolved", "calls_unresolved", "calls_ambiguous", "files", "tree_files", "imports_ambiguous")


@sql("SELECT type, severity, subject, description, n_files::INT AS n_files, row_number() OVER (ORDER BY s, o, subject)::BIGINT AS rank FROM srcissues ORDER BY 6 LIMIT 30", "srcissues")
def source_issues(spark, sf_dir) -> DataFrame:
    return _engine(spark, sf_dir).issues().select("type", "severity", "subject", "description", F.size("files").alias("n_files"), "rank")


@sql("SELECT p::BIGINT AS place, depth::BIGINT AS depth, node, parent, 'imports' AS relationship FROM (SELECT row_number() OVER (ORDER BY dst) AS p, 1 AS depth, dst AS node, src AS parent FROM brought WHERE src = 'pkg/nation_0.py' UNION ALL SELECT (SELECT count(*) FROM brought WHERE src = 'pkg/nation_0.py') + row_number() OVER (ORDER BY q, node), 2, node, parent FROM (SELECT b.dst AS node, min(a.dst) AS q, min(b.src) AS parent FROM brought a JOIN brought b ON b.src = a.dst WHERE a.src = 'pkg/nation_0.py' AND b.dst <> a.src AND b.dst NOT IN (SELECT dst FROM brought WHERE src = 'pkg/nation_0.py') GROUP BY 1))", "brought")
def source_trace(spark, sf_dir) -> DataFrame:
    return _engine(spark, sf_dir).trace("pkg/nation_0.py", "forward", 2)[0].select("place", "depth", "node", "parent", "relationship")


# Diagrams


@sql("SELECT page_id, CASE WHEN base = '' THEN 'unknown' WHEN regexp_matches(base, '^[0-9]') OR lower(base) IN ('class', 'classdef', 'click', 'direction', 'end', 'flowchart', 'graph', 'linkstyle', 'style', 'subgraph') THEN 'node_' || base ELSE base END AS diagram_id FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS base FROM pages)")
def sanitize_ids(spark, sf_dir) -> DataFrame:
    return rel.table(spark, sf_dir, "pages").select("page_id", text.diagram_id(F.col("url")).alias("diagram_id"))


@sql("SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(CASE WHEN length(url) > 30 THEN url[1:27] || '...' ELSE url END, '[\\x00-\\x1f\\x7f]+', ' ', 'g'), '&', '&amp;'), '\\', '&#92;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS label FROM pages")
def label_escape(spark, sf_dir) -> DataFrame:
    return rel.table(spark, sf_dir, "pages").select("page_id", text.diagram_label(F.col("url")).alias("label"))
