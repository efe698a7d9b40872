"""URL rules with redirect equivalence: aliases of a blocked URL are blocked, unless a rule allows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import read
from tidemark.llm.components import connected_components

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number travel to all executors; more are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Query parameters that do not choose another page.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The URL without its fragment, tracking and empty parameters, which name the same page."""
    bare = F.substring_index(url, "#", 1)
    page = F.substring_index(bare, "?", 1)
    query = F.filter(F.split(F.substr(bare, F.char_length(page) + 2), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.concat(page, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


#: Comments (an open one reaches the end), scripts and styles: what stands in them declares nothing.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"
#: Tags that can declare an alias; a quoted value may hold a >.
TAGS = r"""(?is)<(?:link|meta|base)[\s/](?:[^>"']|"[^"]*"|'[^']*')*>"""
#: An attribute's name and value, with or without quotes; values are passed over whole, so nothing inside them counts.
ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: The address in a refresh: after seconds and a separator, with or without url= and quotes.
REFRESH = r"""(?is)^\s*[0-9.]+\s*[;,\s]\s*(?:url\s*=)?\s*["']?([^"']*)"""
AMPERSAND = "(?i)&(?:amp|#38|#x26);"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def _attribute(tag: Column, name: str) -> Column:
    """The first value that a tag gives an attribute, without quotes and with & decoded; null where it gives none."""
    names, values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2))
    at = F.array_position(F.transform(names, F.lower), name)
    value = F.when(at > 0, F.try_element_at(values, F.nullif(at, F.lit(0)).cast("int")))
    bare = F.when(value.rlike("^[\"']"), F.substr(value, F.lit(2), F.char_length(value) - 2)).otherwise(value)
    return F.regexp_replace(bare, AMPERSAND, "&")


def resolved(target: Column, base: Column) -> Column:
    """The URL that target names on a page at base: absolute, of the same scheme (//), host (/), page (?) or folder; dots are
    taken out of paths that were relative. Null for other schemes, fragments and nothing, and where base is no URL."""
    target = F.regexp_replace(target, r"^\s+|\s+$", "")
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    scheme, site = F.regexp_extract(base, r"^(.*?)://", 1), F.regexp_extract(base, r"^.*?://[^/?#]*", 0)
    folder = F.regexp_replace(F.substr(page, F.char_length(site) + 1), "[^/]*$", "")
    path = F.when(target.startswith("/"), target).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), target))
    plain, rest = F.regexp_extract(path, r"^[^?#]*", 0), F.regexp_extract(path, r"[?#].*$", 0)
    steps = F.split(F.substr(plain, F.lit(2)), "/")
    steps = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    walked = F.aggregate(steps, F.lit(""), lambda done, x: F.when(x == ".", done).when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x)))
    out = F.when(target.rlike(SCHEME), F.when(target.contains("://"), target))
    out = out.when(site == "", F.lit(None)).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
    return out.when((target == "") | target.startswith("#"), F.lit(None)).when(target.startswith("?"), F.concat(page, target)).otherwise(F.concat(site, walked, rest))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): a page's URL and the canonical form of itself and of each URL that it declares, by <link rel=canonical> or
    <meta http-equiv=refresh>.

    Attributes may stand in any order, with double, single or no quotes; a rel may hold several words. URLs may be
    relative: to the page, or to its first <base href>. & may be written as an entity. Comments, scripts and styles
    declare nothing, nor do other schemes (mailto:) and fragments. Null URLs have no edges, URLs without :// only those to
    absolute URLs that they declare; null html declares nothing.
    """
    # Values go from step to step through explode(), past which the optimiser takes no filter: it would put the expression
    # of each step into the next one's wherever that names it.
    once = lambda x: F.explode(F.array_compact(F.array(x)))
    html = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), HIDDEN, "")
    tags = pages.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("a"), once(F.regexp_extract_all(html, F.lit(TAGS), F.lit(0))).alias("tags"))
    first = F.try_element_at(F.filter("tags", lambda t: t.rlike("(?i)^<base") & _attribute(t, "href").isNotNull()), F.lit(1))
    based = tags.select("a", "tags", once(F.coalesce(_attribute(first, "href"), F.lit(""))).alias("href"))
    based = based.select("a", "tags", once(F.coalesce(resolved(F.col("href"), F.col("a")), "a")).alias("base"))
    names = {"rel": "rel", "href": "href", "equiv": "http-equiv", "content": "content"}
    each = based.select("a", "base", F.explode("tags").alias("tag"))
    each = each.select("a", "base", once(F.struct(F.lower(F.substr("tag", F.lit(2), F.lit(4))).alias("kind"), *(_attribute(F.col("tag"), v).alias(k) for k, v in names.items()))).alias("t"))
    link = F.when((F.col("t.kind") == "link") & F.array_contains(F.split(F.lower("t.rel"), r"\s+"), "canonical"), F.col("t.href"))
    refresh = F.when((F.col("t.kind") == "meta") & (F.lower("t.equiv") == "refresh"), F.nullif(F.regexp_extract("t.content", REFRESH, 1), F.lit("")))
    declared = each.select("a", "base", once(F.coalesce(link, refresh)).alias("b")).select("a", once(resolved(F.col("b"), F.col("base"))).alias("b"))
    own = pages.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("a"), F.col(url_col).alias("b"))
    targets = declared.union(own).select("a", once(canonical(F.col("b"))).alias("b"))
    return targets.filter(F.col("b").contains("://") & (F.col("a") != F.col("b"))).distinct()


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    table = spark.createDataFrame([(v, h, p, h + p) for v, h, p in rules], "rule_verdict string, rule_host string, rule_path string, rule string")
    return F.broadcast(table) if len(rules) <= BROADCAST_RULES else table


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct URLs with host, path and the longest fitting rule (null: none), as rule and rule_verdict."""
    rows = urls.select(F.col(url_col).alias("url")).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = rows.select("url", "path", F.explode(suffixes).alias("rule_host"))
    fits = tried.join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "rule_verdict")).alias("best"))
    return rows.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], extra_edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, component (the smallest URL of its aliases).

    A page's own longest rule decides, allow or block. Where none fits, the page is blocked when a rule blocks any URL
    of its component over alias_edges (canonical link, refresh, tracking-free) and extra (a, b) redirect edges; else
    default holds.
    So an explicit allow always wins over a propagated block.

    Null, empty or scheme-less URLs have empty host and path, fit no rule and get default. Null html declares nothing.
    Repeated URLs and rows share one verdict; null and repeated ids are kept as they are. Rules of equal length: the
    longer host wins. Other columns are ignored. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    edges = alias_edges(rows)
    if extra_edges is not None:
        ends = extra_edges.select(F.explode(F.array("a", "b")).alias("a"))
        edges = edges.union(extra_edges.select("a", "b")).union(ends.select("a", canonical(F.col("a")).alias("b")).filter("a <> b"))
    components = connected_components(edges)
    table = rule_table(spark, rules)
    judged = match_rules(rows.select("url").union(components.select("node")), table)
    blocked = components.join(judged.filter("rule_verdict = 'block'").select(F.col("url").alias("node")), "node", "left_semi").select("component").distinct()
    alias = components.join(blocked.withColumn("tainted", F.lit(True)), "component", "left").select(F.col("node").alias("url"), "component", "tainted")
    verdict = F.coalesce("rule_verdict", F.when(F.col("tainted"), "block"), F.lit(default))
    full = judged.join(alias, "url", "left").select("url", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "url").alias("component"))
    out = rows.select("id", "url").join(full, "url", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), "component")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"), RULES).drop("component")


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _value(tag: str, name: str) -> str:
    return f"{tag}.parts[list_position({tag}.names, '{name}')]"


def _resolved_sql(source: str, name: str) -> str:
    """CTEs that resolve the targets of a table (url, target, base)."""
    return rf"""{name}_cut AS (SELECT url, base, regexp_replace(target, '^\s+|\s+$', '', 'g') AS t, regexp_extract(base, '^[^?#]*') AS page, regexp_extract(base, '^(.*?)://', 1) AS scheme, regexp_extract(base, '^.*?://[^/?#]*') AS site FROM {source}),
{name}_path AS (SELECT *, CASE WHEN t LIKE '/%' THEN t ELSE coalesce(nullif(regexp_replace(substr(page, length(site) + 1), '[^/]*$', ''), ''), '/') || t END AS p FROM {name}_cut),
{name}_steps AS (SELECT *, string_split(substr(regexp_extract(p, '^[^?#]*'), 2), '/') AS steps FROM {name}_path),
{name} AS (SELECT url, CASE WHEN t IS NULL THEN NULL WHEN regexp_matches(t, '{SCHEME}') THEN CASE WHEN t LIKE '%://%' THEN t END WHEN site = '' THEN NULL WHEN t LIKE '//%' THEN scheme || ':' || t
  WHEN t = '' OR t LIKE '#%' THEN NULL WHEN t LIKE '?%' THEN page || t
  ELSE site || list_reduce(list_prepend('', CASE WHEN steps[-1] IN ('.', '..') THEN list_append(steps, '') ELSE steps END), lambda done, x: CASE x WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END) || regexp_extract(p, '[?#].*$') END AS b FROM {name}_steps)"""


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}')" for v, h, p in RULES)
OP9_SQL = rf"""
WITH RECURSIVE rules(v, rh, rp, rule) AS (VALUES {_RULE_ROWS}),
shown AS (SELECT url, regexp_replace(coalesce(html, ''), '{_quoted(HIDDEN)}', '', 'g') AS html FROM pages WHERE url IS NOT NULL),
tags AS (SELECT url, list_transform(regexp_extract_all(html, '{_quoted(TAGS)}'), lambda t: struct_pack(kind := lower(substr(t, 2, 4)),
    names := list_transform(regexp_extract_all(t, '{_quoted(ATTRIBUTE)}', 1), lambda x: lower(x)),
    parts := list_transform(regexp_extract_all(t, '{_quoted(ATTRIBUTE)}', 2), lambda x: regexp_replace(CASE WHEN x[1] IN ('"', '''') THEN substr(x, 2, length(x) - 2) ELSE x END, '{AMPERSAND}', '&', 'g')))) AS tags FROM shown),
asked AS (SELECT url, list_filter(tags, lambda t: t.kind = 'base' AND list_contains(t.names, 'href'))[1] AS b, tags FROM tags),
asks(url, target, base) AS (SELECT url, CASE WHEN b IS NOT NULL THEN {_value("b", "href")} END, url FROM asked),
{_resolved_sql("asks", "bases")},
opened AS (SELECT a.url, coalesce(r.b, a.url) AS base, a.tags FROM asked a JOIN bases r ON a.url = r.url),
single AS (SELECT url, base, unnest(tags) AS t FROM opened),
links(url, target, base) AS (SELECT url, CASE WHEN t.kind = 'link' AND list_contains(regexp_split_to_array(lower({_value("t", "rel")}), '\s+'), 'canonical') THEN {_value("t", "href")}
  WHEN t.kind = 'meta' AND lower({_value("t", "http-equiv")}) = 'refresh' THEN nullif(regexp_extract({_value("t", "content")}, '{_quoted(REFRESH)}', 1), '') END, base FROM single),
{_resolved_sql("links", "found")},
all_targets AS (SELECT url, b FROM found WHERE b IS NOT NULL UNION SELECT url, url FROM pages WHERE url IS NOT NULL),
cut AS (SELECT url, split_part(split_part(b, '#', 1), '?', 1) AS page,
          list_filter(string_split(substr(split_part(b, '#', 1), length(split_part(split_part(b, '#', 1), '?', 1)) + 2), '&'),
            lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}')) AS params FROM all_targets),
edges AS (SELECT DISTINCT a, b FROM (SELECT url AS a, page || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS b FROM cut) WHERE a <> b AND b LIKE '%://%'),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
urls AS (SELECT DISTINCT url FROM pages UNION SELECT b FROM edges),
parts AS (SELECT url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
          regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM urls),
best AS (SELECT url, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
         FROM parts LEFT JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY url, host, path),
reach(a, b) AS (SELECT url, url FROM urls UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
tainted AS (SELECT DISTINCT r.a AS url FROM reach r JOIN best t ON r.b = t.url AND t.v = 'block')
SELECT p.page_id, b.host, b.path, b.rule,
       coalesce(b.v, CASE WHEN t.url IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages p JOIN best b ON p.url IS NOT DISTINCT FROM b.url LEFT JOIN tainted t ON p.url = t.url
"""
