"""URL filter with redirect equivalence (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) as the query's contract fixes them.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Up to so many rules are compiled into one expression; more are joined by host suffix.
INLINE_RULES = 200

_LINK = r"(?is)<link\b[^>]*[\s\x22'/]rel\s*=\s*(?:\x22(?:[^\x22>]*\s)?canonical[\s\x22]|'(?:[^'>]*\s)?canonical[\s']|canonical[\s/>])[^>]*>?"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\x22']?\s*refresh\b[^>]*>"
#: What holds no elements: comments, and text of other kinds.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes|template)\b[^>]*>.*?(?:</\1\s*>|\z)"
#: Names of character references of signs that occur in urls; & last.
_SIGNS = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&sol;": "/", "&colon;": ":", "&quest;": "?", "&equals;": "=", "&num;": "#", "&period;": ".", "&lowbar;": "_", "&percnt;": "%", "&amp;": "&"}
_BASE = r"(?is)<base\b[^>]*\bhref\s*=[^>]*>"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))


def with_host_and_path(df: DataFrame) -> DataFrame:
    """Adds host and path of column ``url``; both empty without ``://`` or for null."""
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def _key(url: Column) -> Column:
    """What identifies a url among aliases: host, path and query; scheme and fragment don't count."""
    rest = F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.concat(host, F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1))


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def apply_rules(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` (null without a fitting rule) to rows with host and path.

    The longest rule string wins; at equal length the longer host, then allow.
    """
    order = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow", r))
    if len(order) <= INLINE_RULES:
        rule = verdict = None
        for v, h, p in order:
            fits = _fits(F.col("host"), F.col("path"), h, p)
            rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
            verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
        none = F.lit(None).cast("string")
        return df.withColumn("rule", none if rule is None else rule).withColumn("rule_verdict", none if verdict is None else verdict)
    table = df.sparkSession.createDataFrame([(h, p, v, k) for k, (v, h, p) in enumerate(order)], "suffix string, rule_path string, rule_verdict string, place long")
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    fitting = (
        df.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).join(table, "suffix").where("startswith(path, rule_path)")
        .groupBy("host", "path").agg(F.min_by(F.struct(F.concat("suffix", "rule_path").alias("rule"), "rule_verdict"), "place").alias("best"))
    )
    return df.join(fitting, ["host", "path"], "left").withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.rule_verdict")).drop("best")


def _value(tag: Column, name: str) -> Column:
    """An attribute's value, which a quote ends that began it."""
    found = [F.nullif(F.regexp_extract(tag, rf"(?is)[\s\x22'/]{name}\s*=\s*{value}", 1), F.lit("")) for value in (r"\x22([^\x22>]*)", r"'([^'>]*)", r"([^\x22'\s>][^\s>]*)")]
    return F.coalesce(*found)


def _plain(text: Column) -> Column:
    """Text with its character references decoded, without white space at its ends and without line ends and tabs."""
    hexed = lambda r: F.when(r.rlike("^&#[xX]"), F.regexp_extract(r, "([0-9a-fA-F]+);", 1)).otherwise(F.conv(F.regexp_extract(r, "([0-9]+);", 1), 10, 16))
    sign = lambda r: F.decode(F.unhex(F.lpad(hexed(r), 8, "0")), "UTF-32")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[0-9]{1,6}|[xX][0-9a-fA-F]{1,5});"), 0))
    text = F.aggregate(found, text, lambda t, r: F.replace(t, r, F.coalesce(sign(r), r)))
    for name, to in _SIGNS.items():
        text = F.replace(text, F.lit(name), F.lit(to))
    return F.regexp_replace(text, r"^\s+|\s+$|[\t\r\n]", "")


def _refresh(content: Column) -> Column:
    """The target of a refresh: after seconds, a separator and ``url=``; a quote that begins it ends it."""
    rest = F.regexp_extract(content, r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*(.*)$", 1)
    return F.when(rest.rlike("^[\x22']"), F.regexp_extract(rest, r"(?s)^([\x22'])(.*?)(?:\1|$)", 2)).otherwise(rest)


def _resolved(target: Column, base: Column) -> Column:
    """``target`` as an absolute url, seen from ``base``; null where it is empty or of a scheme without ``//``."""
    site, scheme = F.regexp_extract(base, "^(.*?://[^/?#]*)", 1), F.regexp_extract(base, "^(.*?:)//", 1)
    path = F.regexp_extract(base, "^.*?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    own, more = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_extract(target, "^[^?#]*(.*)$", 1)
    full = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_extract(path, "^(.*)/", 1), F.lit("/"), own))
    steps = F.slice(F.split(full, "/"), 2, 1 << 30)
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)),
    )
    last = F.when(F.element_at(steps, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return (
        F.when(F.coalesce(target, F.lit("")) == "", None)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(own == "", F.concat(site, path, F.when(more.startswith("?"), more).otherwise(query)))
        .otherwise(F.concat(site, F.lit("/"), F.array_join(last, "/"), more))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): keys of urls that a canonical link or a refresh makes equivalent.

    Relative targets are resolved against the page's first base href, itself
    resolved against the page's url, or else against that url. Tags inside
    comments, scripts and the like are none. Targets of
    other schemes (without ``//``), empty ones, and pages without a url give
    no edge.
    """
    tags = F.concat(F.regexp_extract_all("html", F.lit(_LINK), 0), F.regexp_extract_all("html", F.lit(_META), 0))
    marked = pages.where(F.col("html").rlike("(?i)canonical|refresh") & (F.instr("url", "://") > 0))
    marked = marked.select("url", F.regexp_replace("html", _HIDDEN, " ").alias("html"))
    found = cut(marked.select("url", F.regexp_extract("html", _BASE, 0).alias("base"), F.explode(tags).alias("tag")))  # one read of the pages
    if found.isEmpty():
        return found.select(F.col("url").alias("u"), F.col("tag").alias("v"))
    # cut after each step, which names its columns many times: else the optimizer writes all steps out in one expression
    is_link = F.col("tag").rlike("(?i)^<link")
    value = F.when(is_link, _value(F.col("tag"), "href")).otherwise(_value(F.col("tag"), "content"))
    found = cut(found.select("url", _value(F.col("base"), "href").alias("base"), value.alias("value"), is_link.alias("is_link")))
    found = cut(found.select("url", _plain(F.col("base")).alias("base"), _plain(F.col("value")).alias("value"), "is_link"))
    target = F.when(F.col("is_link"), F.col("value")).otherwise(_refresh(F.col("value")))
    found = found.select("url", "base", F.trim(target).alias("target"))
    found = cut(found.withColumn("base", F.coalesce(_resolved(F.col("base"), F.col("url")), F.col("url"))))
    absolute = _resolved(F.col("target"), F.col("base"))
    return found.select(_key(F.col("url")).alias("u"), absolute.alias("url")).where("url is not null").select("u", _key(F.col("url")).alias("v")).where("u != v").distinct()


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (and alias_component) of every row of ``pages`` (page_id, url, html).

    A fitting rule decides. Other urls take the decision of their aliases:
    urls joined by redirects or canonical links form components, in which an
    explicit allow goes before any block; without a decision a url is allowed.
    ``edges`` (u, v: keys as host + path + query) adds redirects from
    elsewhere, such as a crawl log. A null url has empty host and path and is
    allowed; repeated rows are judged alike; an empty table gives no rows;
    further columns are ignored.
    """
    links = alias_edges(pages)
    if edges is not None:
        links = links.union(edges.select("u", "v")).distinct()
    links = cut(links)
    rows = apply_rules(with_host_and_path(pages.select("page_id", "url")), rules)
    if links.isEmpty():
        rows = rows.withColumn("alias_component", F.lit(None).cast("string")).withColumn("inherited", F.lit(None).cast("string"))
    else:
        members = cut(connected_components(links))
        judged = apply_rules(with_host_and_path(members.select("node", "component", F.concat(F.lit("x://"), "node").alias("url"))), rules)
        verdicts = judged.groupBy("component").agg(
            F.when(F.expr("bool_or(rule_verdict = 'allow')"), "allow").when(F.expr("bool_or(rule_verdict = 'block')"), "block").alias("inherited")
        )
        decided = members.join(verdicts, "component").select(F.col("node").alias("key"), F.col("component").alias("alias_component"), "inherited")
        rows = rows.withColumn("key", F.when(F.instr("url", "://") > 0, _key(F.col("url")))).join(decided, "key", "left").drop("key")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "inherited", F.lit("allow")).alias("verdict"), "alias_component")


def op1_url_filter(spark, sf_dir):
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


#: Without canonical links and redirects among the pages, of which the tables have none, aliases decide nothing.
SQL = r"""
WITH r AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), m AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict,
       CAST(NULL AS VARCHAR) AS alias_component FROM m
"""
