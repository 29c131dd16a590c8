"""URL filters with redirect equivalence, in DataFrame functions only.

Rules (verdict, host, path) decide the urls they fit: the host or a subdomain of it, and a path that
starts with the rule's; the longest one wins. Redirects and canonical links make urls aliases:
their connected components (see ``_spark.components``) share decisions. A url without a rule is
blocked if an alias is blocked by a rule and none is allowed by one: an explicit allow goes before a
block that is only passed on. All other urls are allowed.

Aliases are told from a page's own html (every ``<link rel=canonical>`` and ``<meta
http-equiv=refresh>`` outside of comments, with ``&amp;`` decoded) and from a table of redirects, if
one is given. Urls that differ only in scheme, fragment or the case of the host are one.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule, has no alias
and is allowed; relative link targets are resolved against the page's url (host, folder or query, dot
segments removed), those of another kind (``mailto:``) are no alias; repeated rows are judged alike;
an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import components, cut, small

#: The production rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An unclosed comment hides the rest of the page; a tag ends where the next one begins. Every pattern
#: reads a text, and then each tag, once.
_COMMENT = "(?s)<!--.*?(?:-->|\\z)"
_TAG = "(?is)<(?:link|meta)\\b[^<>]*+>"
_CANONICAL, _REFRESH = "(?i)\\brel\\s*+=\\s*+[\"']?canonical\\b", "(?i)\\bhttp-equiv\\s*+=\\s*+[\"']?refresh\\b"
_HREF, _URL = "(?i)\\bhref\\s*+=\\s*+[\"']?([^\"'\\s>]++)", "(?i)\\burl\\s*+=\\s*+['\"]?([^\"'\\s>]++)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url without scheme and fragment, null if it has no ``://``."""
    rest = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), rest))


def _without_dots(path: Column) -> Column:
    """A path (from its first slash) without its ``.`` and ``..`` segments."""
    segments = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).otherwise(F.concat(acc, F.lit("/"), x))
    out = F.aggregate(segments, F.lit(""), step)
    return F.when(path.rlike("/[.]"), F.concat(out, F.when(path.rlike("/[.][.]?$"), F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def resolved(url: Column, target: Column) -> Column:
    """A link's target as a url with ``://``, seen from the page's url; null if it is none."""
    path = path_of(url)
    folder = F.when(path.contains("/"), F.regexp_extract(path, "(?s)^(.*/)", 1)).otherwise(F.lit("/"))
    own, query = F.regexp_extract(target, "(?s)^([^?#]*)", 1), F.regexp_extract(target, "(?s)^[^?#]*(.*)$", 1)
    at = F.when(own.startswith("/"), own).when(own == "", path).otherwise(F.concat(folder, own))
    here = F.concat(F.lit("http://"), host_of(url), _without_dots(at), query)
    out = F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target))
    return out.when(target.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|#)"), F.lit(None)).otherwise(here)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule (host and path) and verdict; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def aliases(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between url nodes: canonical and refresh links of pages, and redirects (source, target)."""
    linked = pages.select("url", "html").where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|http-equiv"))
    tags = F.regexp_extract_all(F.regexp_replace("html", _COMMENT, ""), F.lit(_TAG), F.lit(0))
    linked = linked.select("url", F.explode(F.array_distinct(tags)).alias("tag"))
    is_link = F.lower(F.substring("tag", 2, 4)) == "link"
    target = F.when(is_link & F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(~is_link & F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _URL, 1))
    edges = linked.select("url", target.alias("target")).where("target != ''").distinct()
    edges = edges.select("url", resolved(F.col("url"), F.regexp_replace("target", "(?i)&(?:amp|#38|#x26);", "&")).alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("source").alias("url"), "target"))
    return edges.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))


def judge(pages: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    comps = components(aliases(pages, redirects))
    url = F.concat(F.lit("://"), F.col("node"))
    known = comps.withColumn("verdict", rule_of(host_of(url), path_of(url), rules)["verdict"])
    shared = known.groupBy("component").agg(F.max((F.col("verdict") == "block").cast("int")).alias("block"), F.max((F.col("verdict") == "allow").cast("int")).alias("allow"))
    blocked = shared.where("block = 1 and coalesce(allow, 0) = 0").select("component")
    blocked = small(cut(comps.join(blocked, "component").select("node").distinct()).withColumn("passed", F.lit("block")), 100_000)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).join(blocked, "node", "left")
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "passed", F.lit("allow")).alias("verdict"))


JUDGE_SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, url, html, url LIKE '%://%' AS good FROM pages),
parsed AS (SELECT page_id, html, url, good,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1), '') AS rest FROM p),
links AS (SELECT host || rest AS a, host, path, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g'), '(?is)<(?:link|meta)\b[^<>]*>')) AS tag FROM parsed WHERE good AND html IS NOT NULL),
t AS (SELECT DISTINCT a, host, path, regexp_replace(target, '(?i)&(?:amp|#38|#x26);', '&', 'g') AS target FROM (SELECT a, host, path,
    CASE WHEN lower(tag[2:5]) = 'link' AND regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN lower(tag[2:5]) = 'meta' AND regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*[''"]?([^"''\s>]+)', 1) END AS target FROM links) WHERE target <> ''),
s AS (SELECT *, regexp_extract(target, '(?s)^([^?#]*)', 1) AS own FROM t),
f AS (SELECT *, CASE WHEN own LIKE '/%' THEN own WHEN own = '' THEN path WHEN path LIKE '%/%' THEN regexp_extract(path, '(?s)^(.*/)', 1) || own ELSE '/' || own END AS full_path FROM s),
u AS (SELECT a, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN target LIKE '//%' THEN 'http:' || target
    WHEN regexp_matches(target, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|#)') THEN NULL
    ELSE 'http://' || host || CASE WHEN NOT regexp_matches(full_path, '/[.]') THEN full_path
        ELSE list_reduce(list_concat([''], string_split(full_path, '/')[2:]), lambda acc, x: CASE x WHEN '.' THEN acc WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END)
            || CASE WHEN regexp_matches(full_path, '/[.][.]?$') THEN '/' ELSE '' END END || substr(target, length(own) + 1) END AS b FROM f),
e AS (SELECT a, translate(regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(b, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b FROM u WHERE b IS NOT NULL),
twoway AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS other FROM twoway UNION SELECT r.node, x.b FROM reach r JOIN twoway x ON r.other = x.a),
rules(verdict, h, pa) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
n AS (SELECT DISTINCT node, translate(regexp_extract(node, '^[^/?]*'), '', '') AS host, regexp_extract(node, '(?s)^[^/?]*([^?]*)', 1) AS path FROM reach),
nv AS (SELECT node, arg_max(verdict, length(h || pa)) AS verdict FROM n JOIN rules ON (n.host = h OR suffix(n.host, '.' || h)) AND prefix(n.path, pa) GROUP BY node),
passed AS (SELECT r.node FROM reach r JOIN nv ON r.other = nv.node GROUP BY r.node HAVING bool_or(nv.verdict = 'block') AND NOT bool_or(nv.verdict = 'allow')),
hp AS (SELECT DISTINCT host, path FROM parsed),
own AS (SELECT host, path, arg_max(h || pa, length(h || pa)) AS rule, arg_max(verdict, length(h || pa)) AS verdict
    FROM hp JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, pa) GROUP BY host, path)
SELECT x.page_id, x.host, x.path, own.rule, coalesce(own.verdict, CASE WHEN passed.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM parsed x LEFT JOIN own ON x.host = own.host AND x.path = own.path LEFT JOIN passed ON x.good AND passed.node = x.host || x.rest
"""
