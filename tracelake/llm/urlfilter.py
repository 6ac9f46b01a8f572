"""URL filters with redirect equivalence.

Rules are (host, path) with a verdict; a rule fits its host and all subdomains where the url's path starts with its
path, and the longest fitting rule wins. Pages that redirect to each other or name a canonical url are aliases:
connected components over <meta http-equiv=refresh>, <link rel=canonical> and og:url edges between normalised urls.
A component with a url that a rule blocks, be it of a page or only named as a target, blocks its members that no rule decides; a
rule's allow takes precedence on the pages it fits. All other pages are allowed.

Normalised url: host lower-cased, without default port; scheme, `#` part and a trailing slash of the path are not part of it.
Relative targets are resolved against the page's host (leading slash) or folder.

Cases: a null url or one without `://` has empty host and path, no rule and no aliases, verdict allow; null html has no
edges; repeated rows get a row each; an empty table gives no rows; ties of equal length cannot occur between rules
that fit the same url unless they are equal; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, components, shared_dir, stored, table

#: (host, path, verdict), a list of fixed size.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, nulls if none fits. rules: a short fixed list, tried longest first."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def normal(url: Column) -> Column:
    """Key under which urls are the same page; null without `://`."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.regexp_replace(rest, r"/+(\?|$)", "$1")
    return F.when(url.contains("://") & (host != ""), F.concat(host, rest))


def _absolute(target: Column, url: Column) -> Column:
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, target)).when(target.startswith("/"), F.concat(root, target)).otherwise(F.concat(folder, target))


_ATTR = r"""(?is)\b{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attr(tag: Column, name: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, _ATTR.format(name), k), F.lit("")) for k in (1, 2, 3)])


def alias_edges(pages: DataFrame, base: str, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(a, b): normalised urls of pages and of what they redirect to or call canonical; (node): targets that a rule blocks; both stored."""
    html = F.coalesce("html", F.lit(""))
    tags = pages.where(F.col("url").contains("://") & html.rlike(r"(?i)canonical|refresh|og:url"))
    tags = tags.select("url", F.explode(F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))).alias("tag"))
    # Written between the steps: each uses its input many times, and as one expression the code would grow too large.
    tags = stored(tags.where(F.col("tag").rlike(r"(?i)canonical|refresh|og:url")), f"{base}/tags")
    rel, equiv, prop = _attr(F.col("tag"), "rel"), _attr(F.col("tag"), "http-equiv"), _attr(F.col("tag"), "property")
    to = (
        F.when(rel.rlike(r"(?i)(^|\s)canonical(\s|$)"), _attr(F.col("tag"), "href"))
        .when(F.lower(equiv) == "refresh", F.regexp_extract(_attr(F.col("tag"), "content"), r"""(?i)url\s*=\s*['"]?([^'"]+)""", 1))
        .when(F.lower(prop) == "og:url", _attr(F.col("tag"), "content"))
    )
    found = stored(tags.select("url", F.replace(F.trim(to), F.lit("&amp;"), F.lit("&")).alias("to")).where("to <> ''"), f"{base}/targets")
    full = stored(found.select("url", _absolute(F.col("to"), F.col("url")).alias("to")), f"{base}/absolute")
    named = stored(full.select(normal(F.col("url")).alias("a"), normal(F.col("to")).alias("b"), host_of(F.col("to")).alias("host"), path_of(F.col("to")).alias("path")).where("b IS NOT NULL"), f"{base}/named")
    edges = stored(named.where("a IS NOT NULL AND a <> b").select("a", "b").distinct(), f"{base}/edges")
    bad = named.where(rule_of(F.col("host"), F.col("path"), rules)[1] == "block").select(F.col("b").alias("node")).distinct()
    return edges, stored(bad, f"{base}/bad")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, blocked_by_alias."""
    base = shared_dir(pages.sparkSession)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", rule).withColumn("own", verdict)
    edges, bad = alias_edges(pages, base, rules)
    roots = components(edges)
    # Urls without a key get one of their own, so that they do not meet in one task.
    keyed = seen.withColumn("node", F.coalesce(normal(F.col("url")), F.concat(F.lit("://"), F.col("page_id").cast("string"))))
    in_class = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    targets = bad.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"))
    blocked = in_class.where("own = 'block' AND root IS NOT NULL").select("root").union(targets).distinct().withColumn("hit", F.lit(True))
    out = in_class.join(blocked, "root", "left")
    alias = F.col("own").isNull() & F.coalesce("hit", F.lit(False))
    final = F.coalesce("own", F.when(alias, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"), alias.alias("blocked_by_alias"))


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("blocked_by_alias")


_SQL_ATTR = r"""nullif(regexp_extract({0}, '(?is)\b{1}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', {2}), '')"""


def _sql_attr(tag: str, name: str) -> str:
    return "coalesce(" + ", ".join(_SQL_ATTR.format(tag, name, k) for k in (1, 2, 3)) + ")"


_SQL_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_HOST = _SQL_LOW.format(r"regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1)")
_SQL_NORMAL = (
    r"CASE WHEN contains({0}, '://') AND regexp_replace(" + _SQL_HOST + r", ':(80|443)$', '') <> '' THEN regexp_replace(" + _SQL_HOST + r", ':(80|443)$', '') || regexp_replace(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^#]*)', 1), '/+(\?|$)', '\1', 'g') END"
)
_SQL_CASES = sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
_SQL_RULE = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{k}}}" for k, (h, p, v) in enumerate(_SQL_CASES)) + " END"

OP4_SQL = rf"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(html, '') AS html, {_SQL_HOST.format("url")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, {_SQL_RULE.format(*[f"'{h}{p}'" for h, p, _ in _SQL_CASES])} AS rule, {_SQL_RULE.format(*[f"'{v}'" for _, _, v in _SQL_CASES])} AS own, coalesce({_SQL_NORMAL.format("url")}, '://' || r) AS node FROM p),
tag AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM p WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|refresh|og:url')),
dst AS (SELECT url, replace(trim(CASE WHEN regexp_matches({_sql_attr("t", "rel")}, '(?i)(^|\s)canonical(\s|$)') THEN {_sql_attr("t", "href")}
        WHEN lower({_sql_attr("t", "http-equiv")}) = 'refresh' THEN regexp_extract({_sql_attr("t", "content")}, '(?i)url\s*=\s*[''"]?([^''"]+)', 1)
        WHEN lower({_sql_attr("t", "property")}) = 'og:url' THEN {_sql_attr("t", "content")} END), '&amp;', '&') AS x FROM tag),
base AS (SELECT url, x, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root, regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1) AS folder, regexp_extract(url, '(?s)^(.*?:)//', 1) AS scheme FROM dst WHERE x <> ''),
full_url AS (SELECT url, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN x WHEN starts_with(x, '//') THEN scheme || x WHEN starts_with(x, '/') THEN root || x WHEN ends_with(folder, '/') THEN folder || x ELSE folder || '/' || x END AS x FROM base),
e AS (SELECT {_SQL_NORMAL.format("url")} AS a, {_SQL_NORMAL.format("x")} AS b FROM full_url),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
target AS (SELECT {_SQL_NORMAL.format("x")} AS node, {_SQL_HOST.format("x")} AS host, regexp_extract(x, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM full_url),
seed AS (SELECT node FROM j WHERE own = 'block' UNION SELECT node FROM target WHERE {_SQL_RULE.format(*[f"'{v}'" for _, _, v in _SQL_CASES])} = 'block'),
bad(node) AS (SELECT node FROM seed UNION SELECT b FROM bad JOIN both_ways ON a = node)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""
