"""URL filter with redirect equivalence, in DataFrame functions alone.

A url's host and path are matched against allow and block rules; the longest fitting rule decides. A url that no
rule fits takes the decision of its aliases: urls that redirect or canonical-link edges connect form a class
(connected components), and a class with a blocked member blocks the members that no rule allows. An
explicit allow rule always wins for the urls it fits. Aliases are compared in a normal form: scheme and host in lower
case, no fragment, ``&amp;`` as ``&``, an empty path as ``/``. All canonical links and refreshes of a page count.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and has no aliases, so it is
allowed; repeated rows are judged alike and kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, columns, materialize, table
from .graph import connected_components

#: (host, path, verdict) of the query's rules.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (size, rule, verdict), or null; of equally long ones an allow wins."""
    fits = []
    for h, p, verdict in rules:
        covers = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        fits.append(F.when(covers, F.struct(F.lit(len(h + p)).alias("size"), F.lit(int(verdict == "allow")).alias("allow"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    kind = "struct<size:int,allow:int,rule:string,verdict:string>"
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast(kind)


def node_of(url: Column) -> Column:
    """The normal form in which aliases meet, or null where the url has no ``://``."""
    whole = F.regexp_replace(F.replace(url, F.lit("&amp;"), F.lit("&")), "(?s)#.*$", "")
    origin = F.regexp_extract(whole, r"(?s)^(.*?://[^/?]*)", 1)
    rest = F.substr(whole, F.length(origin) + 1)
    return F.when(F.contains(whole, F.lit("://")), F.concat(ascii_lower(origin), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(u, v)`` nodes of the pages' canonical links and meta refreshes; relative ones are resolved against the page's url."""
    links = F.regexp_extract_all("html", F.lit(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""), F.lit(0))
    metas = F.regexp_extract_all("html", F.lit(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""), F.lit(0))
    hrefs = F.transform(links, lambda x: F.regexp_extract(x, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    to = F.transform(metas, lambda x: F.regexp_extract(x, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    origin = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    target = (
        F.when(F.col("v").contains("://"), F.col("v"))
        .when(F.startswith("v", F.lit("//")), F.concat(F.substring_index("url", "//", 1), F.col("v")))
        .when(F.startswith("v", F.lit("/")), F.concat(origin, F.col("v")))
        .otherwise(F.concat(F.regexp_replace(folder, "([^/])$", "$1/"), F.col("v")))
    )
    found = pages.filter(F.col("url").contains("://")).select("url", F.explode(F.concat(hrefs, to)).alias("v")).filter("v <> ''")
    return found.select(node_of(F.col("url")).alias("u"), node_of(target).alias("v")).filter("u <> v")


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` of each page; ``edges`` (u, v) adds redirects known from elsewhere.

    Aliases are joined on the url's normal form, of which edges and rules are functions: the verdict of a class comes from a
    partly pre-aggregated grouping, and the join sides are written tables, so Spark can split hot ones.
    """
    rows = columns(pages, page_id=page_id, url=url, html=html)
    judged = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    links = alias_edges(rows)
    if edges is not None:
        links = links.unionByName(edges.select(node_of(F.col("u")).alias("u"), node_of(F.col("v")).alias("v")))
    members = materialize(connected_components(links))
    fit = fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    blocked = members.filter(fit["verdict"] == "block").select("component").distinct()
    hit = materialize(members.join(blocked, "component").select("node", F.lit(True).alias("alias_blocked")))
    out = judged.withColumn("node", node_of(F.col("url"))).join(hit, "node", "left") if hit.head(1) else judged.withColumn("alias_blocked", F.lit(None).cast("boolean"))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("alias_blocked"), "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY length(h || r.p) DESC) AS k, h || r.p AS rule, v
  FROM p JOIN r ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, r.p)
),
raw AS (
  SELECT url, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS v
  FROM pages WHERE url LIKE '%://%'
  UNION ALL
  SELECT url, regexp_extract(unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
  FROM pages WHERE url LIKE '%://%'
),
target AS (
  SELECT url, CASE WHEN contains(v, '://') THEN v WHEN starts_with(v, '//') THEN split_part(url, '//', 1) || v
                   WHEN starts_with(v, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || v
                   ELSE regexp_replace(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1), '([^/])$', '\1/') || v END AS v
  FROM raw WHERE v <> ''
),
url AS (SELECT DISTINCT url, regexp_replace(replace(url, '&amp;', '&'), '(?s)#.*$', '') AS whole FROM (SELECT url FROM pages UNION ALL SELECT v FROM target) WHERE contains(url, '://')),
node AS (
  SELECT url, translate(o, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || CASE WHEN starts_with(substr(whole, length(o) + 1), '/') THEN '' ELSE '/' END || substr(whole, length(o) + 1) AS n
  FROM (SELECT url, whole, regexp_extract(whole, '(?s)^(.*?://[^/?]*)', 1) AS o FROM url)
),
link AS (SELECT a.n AS u, b.n AS v FROM target t JOIN node a ON a.url = t.url JOIN node b ON b.url = t.v WHERE a.n <> b.n),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(a, b) AS (SELECT u, v FROM edge UNION SELECT reach.a, edge.v FROM reach JOIN edge ON reach.b = edge.u),
-- rules hold for urls that are no page's as well
seen AS (
  SELECT n, regexp_extract(n, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(n, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT n FROM node)
),
judged AS (
  SELECT n, v FROM seen JOIN r ON (seen.host = h OR ends_with(seen.host, '.' || h)) AND starts_with(seen.path, r.p)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(h || r.p) DESC) = 1
)
SELECT p.page_id, p.host, p.path, m.rule,
       coalesce(m.v, CASE WHEN node.n IN (SELECT a FROM reach JOIN judged ON b = n WHERE v = 'block') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1 LEFT JOIN node ON node.url = p.url
"""
