"""URL filter with redirect equivalence: decisions hold for all addresses of a page.

Nodes are addresses (host, path and query; a fragment is no part of one). Edges are declared redirects (meta refresh, `url=`-like
parameters) and declared canonical links. Only on request (`forms`) is an address also an alias of its usual form, without tracking
parameters, `www.`/`m.`, index file, `.html` or last slash, as pages that differ in these need not be one. Connected components over these edges are found distributedly; an address that no rule
fits gets its component's decision: allow if an allow rule fits any of the component's addresses, else block if a block rule
does, else allow. A rule on the address itself always comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import scratch
from lodestone.llm.components import connected_components

#: (verdict, host, path); the rules of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_ASCII_UP, _ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _ASCII_UP, _ASCII_LOW)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*[^?#]*(\\?[^#]*)?", 1)


def rule_fit(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none; among equally long ones the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        rule = F.when(fits(h, p), F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits(h, p), F.lit(v)).otherwise(verdict)
    return rule, verdict


def canonical(host: Column, path: Column, query: Column) -> Column:
    """The usual form of an address. Parameters go only by their whole name."""
    h = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^(www|m)\\.(?=[^.]+\\.)", "")
    p = F.regexp_replace(F.regexp_replace(path, "/index\\.(html?|php)$", "/"), "\\.html?$", "")
    p = F.regexp_replace(p, "/+$", "")
    kept = F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref|fbclid|gclid|source)(=|$)"))
    q = F.array_join(F.array_sort(kept), "&")
    return F.concat(h, p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def _absolute(target: Column, url: Column) -> Column:
    """target as an address with `://`, relative to url; null if it is none of a page."""
    t = F.trim(F.regexp_replace(target, "&amp;", "&"))
    origin = F.regexp_extract(url, "^[^/?#]*://[^/?#]*", 0)
    scheme = F.regexp_extract(url, "^([^/?#]*:)//", 1)
    folder = F.concat(origin, F.regexp_extract(F.concat(path_of(url), F.lit("")), "^(.*/)?", 0))
    return (
        F.when((t == "") | t.startswith("#") | (url.isNull()), None)
        .when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(t.startswith("//"), F.concat(scheme, t))
        .when(t.startswith("/"), F.concat(origin, t))
        .otherwise(F.concat(F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder), t))
    )


def _first_tag(html: Column, name: str, mark: str) -> Column:
    """The first whole tag of that name that the pattern `mark` is found in; null if none. Each tag is read once,
    whatever its length: one that never ends takes the rest of the page, and is none."""
    tags = F.regexp_extract_all(html, F.lit(f"(?i)<{name}\\b[^>]*+(?:>|\\z)"), F.lit(0))
    return F.get(F.filter(tags, lambda t: t.endswith(">") & t.rlike(mark)), F.lit(0))


def declared(url: Column, html: Column) -> Column:
    """Targets that a page declares: canonical link, meta refresh."""
    link = _first_tag(html, "link", "(?i)\\brel\\s*+=\\s*+[\"']?canonical\\b")
    meta = _first_tag(html, "meta", "(?i)\\bhttp-equiv\\s*+=\\s*+[\"']?refresh\\b")
    targets = F.array(
        F.regexp_extract(link, "(?i)\\bhref\\s*+=\\s*+[\"']?([^\"'\\s>]+)", 1),
        F.regexp_extract(meta, "(?i)\\burl\\s*+=\\s*+[\"']?([^\"'\\s>]+)", 1),
    )
    return F.filter(F.transform(targets, lambda t: _absolute(t, url)), lambda t: t.isNotNull())


def redirect_parameter(url: Column) -> Column:
    """The target that an address carries for a redirect (`?url=http...`), null if none."""
    t = F.regexp_extract(query_of(url), "[?&](?:url|to|target|redirect|dest)=(https?(?:://|%3[Aa]%2[Ff]%2[Ff])[^&]+)", 1)
    return F.when(t != "", F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "%3[Aa]", ":"), "%2[Ff]", "/"), "%3[Ff]", "?"))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", rules=RULES, forms: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict, by (rule, alias or default), component (the smallest address of it); a row for each row of pages.

    A null url or one without `://` has empty host and path, no rule and no aliases: verdict allow. Null html declares
    nothing. Repeated pages are judged alike, and pages that repeat an id each get a row. Tags are read whole, however long. Other columns are
    not looked at. forms: aliases of usual forms too. No rows give no rows."""
    url, html = F.col("url"), F.col("html")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), (F.col(html_col) if html_col else F.lit(None).cast("string")).alias("html"))
    host, path = host_of(url), path_of(url)
    node = F.when(host != "", F.concat(host, path, query_of(url)))
    page = rows.select("page_id", host.alias("host"), path.alias("path"), node.alias("node"), canonical(host, path, query_of(url)).alias("own"), F.when(host != "", F.concat(declared(url, html), F.filter(F.array(redirect_parameter(url)), lambda t: t.isNotNull()))).alias("targets"))
    page = scratch(page, "pages")
    aim = F.col("aim")
    aims = page.select("node", F.explode("targets").alias("aim")).select("node", aim, host_of(aim).alias("host"), path_of(aim).alias("path"), query_of(aim).alias("query")).where("host != ''")
    aims = aims.withColumn("to", F.concat("host", "path", "query"))
    edges = aims.select(F.col("node").alias("a"), F.col("to").alias("b"))
    if forms:
        own = page.where("node is not null").select(F.col("node").alias("a"), F.col("own").alias("b"))
        edges = edges.unionByName(own).unionByName(aims.select(F.col("to").alias("a"), canonical(F.col("host"), F.col("path"), F.col("query")).alias("b")))
    comps = connected_components(edges)
    seen = page.where("node is not null").select("node", "host", "path").unionByName(aims.select(F.col("to").alias("node"), "host", "path")).distinct()
    ruled = seen.select("node", rule_fit(F.col("host"), F.col("path"), rules)[1].alias("verdict")).where("verdict is not null")
    marked = ruled.join(comps, "node", "left").select(F.coalesce("component", "node").alias("component"), "verdict")
    marked = marked.groupBy("component").agg(F.min("verdict").alias("inherited"))  # allow comes before block
    rule, verdict = rule_fit(F.col("host"), F.col("path"), rules)
    out = page.select("page_id", "host", "path", "node", rule.alias("rule"), verdict.alias("own")).join(comps, "node", "left")
    out = out.withColumn("component", F.coalesce("component", "node")).join(marked, "component", "left")
    by = F.when(F.col("own").isNotNull(), "rule").when(F.col("inherited").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "inherited", F.lit("allow")).alias("verdict"), by.alias("by"), "component")
