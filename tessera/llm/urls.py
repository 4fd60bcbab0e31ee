"""URL filters with redirect equivalence: decisions spread over pages that redirect or canonicalise to each other.

Rules have the form ``host/path`` and fit a host, its subdomains and every path that begins
with theirs. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, meet
from .store import Workspace

#: (verdict, rule) of the query's rule list.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"""(?is)<(?:link|meta)\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
_CANONICAL = r"""(?is)\brel\s*=\s*["']?\s*canonical\b"""
_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_URL = r"""(?is)\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["']?([^"'>\s]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, ASCII letters lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A page's identity: host, path and query, without scheme and fragment; null where there is no host."""
    tail = F.regexp_extract(_after_scheme(url), "^[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(F.substring(tail, 1, 1) == "/", tail).otherwise(F.concat(F.lit("/"), tail))))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null; of two as long, allow comes first."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[0], r[1]))
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in reversed(ranked):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _resolve(link: Column, url: Column) -> Column:
    """An absolute form of a link found in the page at url."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    base = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_extract(path_of(url), "^(.*/)?", 0)
    return (
        F.when(link == "", F.lit(None))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(F.instr(link, "://") > 0, link))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("#"), F.lit(None))
        .when(link.startswith("?"), F.concat(base, path_of(url), link))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def alias_targets(url: Column, html: Column) -> Column:
    """Array of the nodes that a page's canonical links and meta refreshes lead to."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(bare, F.lit(_TAG), F.lit(0))

    def target(tag: Column) -> Column:
        href = F.concat(*(F.regexp_extract(tag, _HREF, k) for k in (1, 2, 3)))
        return F.when(tag.rlike("(?i)^<link") & tag.rlike(_CANONICAL), href).when(tag.rlike("(?i)^<meta") & tag.rlike(_REFRESH), F.regexp_extract(tag, _URL, 1))

    found = F.filter(F.transform(tags, target), lambda x: x.isNotNull() & (x != ""))
    nodes = F.filter(F.transform(found, lambda x: node_of(_resolve(x, url))), lambda x: x.isNotNull())
    return F.when(html.rlike("(?i)canonical|refresh"), nodes).otherwise(F.array().cast("array<string>"))


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url, html) with host, path, rule and verdict.

    A page's own longest rule decides. A page without one takes the decision of its
    component over alias links: allow if any address in it is allowed by a rule, else block
    if any is blocked, else allow. ``redirects`` (from_url, to_url) adds links that are not in
    the pages. Addresses that no page has still carry their rule's decision.
    """
    ws = Workspace(pages.sparkSession)
    url = F.col("url")
    p = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    p = p.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    links = pages.select(node_of(url).alias("a"), F.explode(alias_targets(url, F.col("html"))).alias("b"))
    if redirects is not None:
        links = links.unionAll(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    comp, size = ws.measured(components(ws, links, "a", "b", "urls"), "components", rows=F.count(F.lit(1)))
    as_url = F.concat(F.lit("http://"), F.col("node"))
    own = comp.withColumn("v", rule_for(host_of(as_url), path_of(as_url), rules)["verdict"])
    decided = own.groupBy("component").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"), F.count("*").alias("n"))
    spread = meet(comp, ws.save(decided, "decided"), "component", "n", size["rows"]).select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("by_alias"))
    j = p.join(spread, "node", "left")
    return j.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "by_alias", F.lit("allow")).alias("verdict"))


def op6_url_filters(pages: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of every page.

    A null url or one without :// has empty host and path, no rule and no aliases, and is
    allowed. Null html has no links. Repeated rows repeat; of two rules as long, allow comes first; an
    empty table gives no rows; extra columns are ignored. Very long pages and addresses are read whole.
    """
    return filter_urls(pages.select("page_id", "url", "html"))


_RULE_ROWS = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
SQL = f"""
WITH RECURSIVE rules(v, r, h, p) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id, html, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS t FROM pages),
s AS (SELECT page_id, html, coalesce(translate(regexp_extract(t, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
      coalesce(regexp_extract(t, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(t, '^[^/?#]*([^#]*)', 1) AS tail FROM u),
n AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN tail LIKE '/%' THEN tail ELSE '/' || tail END END AS node FROM s),
links AS (SELECT node AS a, unnest(regexp_extract_all(html, '(?i)<link[^>]*rel="canonical"[^>]*href="https?://([^"#]*)', 1)) AS b FROM n),
both_ways AS (SELECT a, b FROM links WHERE a IS NOT NULL UNION SELECT b, a FROM links WHERE a IS NOT NULL),
reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT r.x, b.b FROM reach r JOIN both_ways b ON r.y = b.a),
judged AS (SELECT y, arg_max(v, length(r)) AS v FROM (SELECT DISTINCT y FROM reach) q JOIN rules
      ON (split_part(y, '/', 1) = h OR ends_with(split_part(y, '/', 1), '.' || h)) AND starts_with(substr(regexp_extract(y, '^[^?]*'), length(split_part(y, '/', 1)) + 1), p) GROUP BY y),
alias AS (SELECT x, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS v FROM reach JOIN judged USING (y) GROUP BY x),
own AS (SELECT page_id, host, path, node, arg_max(r, length(r)) AS rule, arg_max(v, length(r)) AS v
      FROM n LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(own.v, alias.v, 'allow') AS verdict FROM own LEFT JOIN alias ON node = x
"""
