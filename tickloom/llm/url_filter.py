"""Block and allow decisions for urls, carried over redirect and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm.components import connected_components
from tickloom.llm.registry import query, table
from tickloom.llm.shared import saved

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# First canonical link and first refresh of a page, and where they point.
LINK = r"(?i)<link\b[^>]*\brel=[\"']?canonical\b[^>]*>"
HREF = r"(?i)\bhref=[\"']?([^\"'\s>]+)"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv=[\"']?refresh\b[^>]*>"
TARGET = r"(?i)\burl=[\"']?([^\"'\s>]+)"
# Parameters that name where a visitor came from; a site answers with the page itself.
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def place(url: Column) -> Column:
    """What a url names once usual redirects are followed: scheme, fragment, last slash and tracking do not count."""
    asked = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(asked, TRACKING, ""), "^&", "")
    named = F.concat(host(url), F.regexp_replace(path(url), "/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, named)


def without_dots(path_: Column) -> Column:
    """A path with its ``.`` and ``..`` segments followed; one at the end leaves a slash."""
    segments = F.split(F.regexp_replace(path_, r"/\.{1,2}$", "$0/"), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda out, s: F.when(s == ".", out).when(
        s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(s))))
    return F.when(path_.rlike(r"/\.{1,2}(/|$)"), F.array_join(kept, "/")).otherwise(path_)


def resolved(target: Column, url: Column) -> Column:
    """An address as found in a page, seen from the page: ``&amp;`` is a plain sign, and only a scheme makes it absolute.

    ``//host/x`` names a host, ``/x`` a path, ``x`` and ``../x`` a path beside the page's own, ``?x`` another query of the page.
    Addresses of schemes without a host (``mailto:x``) name no place.
    """
    plain = F.regexp_replace(target, "&amp;", "&")
    asked = F.regexp_extract(plain, r"(?s)^([^?#]*)(\?[^#]*)?", 1), F.regexp_extract(plain, r"(?s)^([^?#]*)(\?[^#]*)?", 2)
    beside = F.concat(F.regexp_extract(F.concat(path(url), F.when(path(url) == "", "/").otherwise("")), r"(?s)^(.*/)", 1), asked[0])
    own = F.when(asked[1] != "", asked[1]).otherwise(F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1))
    here = F.concat(F.lit("http://"), host(url))
    return (F.when(plain == "", None)
            .when(plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), plain)
            .when(plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(plain.startswith("//"), F.concat(F.lit("http:"), plain))
            .when(plain.startswith("/"), F.concat(here, without_dots(asked[0]), asked[1]))
            .when(asked[0] == "", F.concat(here, path(url), own))
            .otherwise(F.concat(here, without_dots(beside), asked[1])))


def matched(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None,
          key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for every page.

    A page that a rule fits has the verdict of the longest such rule.  Any other page is judged by its aliases, the
    connected component of its place over canonical links, page refreshes and ``redirects`` (columns from_url, to_url):
    allowed if a rule allows any of them, else blocked if a rule blocks any, else allowed.  Addresses that are linked to
    but are no page of the table are aliases too, under the same rules.

    Only places with an edge to another place take part in the components; ``component`` is the smallest place, or
    the page's own.  A null url and one without ``://`` have empty host and path, no aliases, and are allowed.  Null
    html has no links; repeated rows keep a row each; an empty table gives an empty result.
    """
    at = F.col("url")
    rows = saved(pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"),
        F.regexp_extract(F.regexp_extract(F.coalesce(html, F.lit("")), LINK, 0), HREF, 1).alias("link"),
        F.regexp_extract(F.regexp_extract(F.coalesce(html, F.lit("")), REFRESH, 0), TARGET, 1).alias("refresh"))
        .select("page_id", "url", host(at).alias("host"), path(at).alias("path"), place(at).alias("place"),
                resolved(F.col("link"), at).alias("link"), resolved(F.col("refresh"), at).alias("refresh"))
        .withColumn("match", matched(F.col("host"), F.col("path"), rules)), "pages")
    hops = (rows.select(at.alias("from_url"), "link").union(rows.select(at.alias("from_url"), "refresh"))
            .toDF("from_url", "to_url"))
    if redirects is not None:
        hops = hops.union(redirects.select("from_url", "to_url"))
    hops = hops.filter("from_url is not null and to_url is not null")
    edges = hops.select(place(F.col("from_url")).alias("a"), place(F.col("to_url")).alias("b"))
    named = saved(connected_components(edges), "aliases")
    # Verdicts by place, of pages and of addresses that are only linked to.
    linked = hops.select(F.col("to_url").alias("url")).union(hops.select(F.col("from_url").alias("url"))).select(
        place(at).alias("place"), matched(host(at), path(at), rules)["verdict"].alias("verdict"))
    votes = (rows.select("place", F.col("match.verdict").alias("verdict")).union(linked).groupBy("place")
             .agg(F.max(F.col("verdict") == "allow").alias("allow"), F.max(F.col("verdict") == "block").alias("block"))
             .filter("place is not null and (allow or block)")
             .join(named, F.col("place") == F.col("node"), "left")
             .groupBy(F.coalesce("component", "place").alias("component"))
             .agg(F.max("allow").alias("allow"), F.max("block").alias("block")))
    # A page without a rule needs its component; all others are done.
    ruled = rows.filter("match is not null").select("page_id", "host", "path", "place", "match")
    rest = rows.filter("match is null").select("page_id", "host", "path", "place", "match")
    judged = (rest.join(named, F.col("place") == F.col("node"), "left")
              .withColumn("component", F.coalesce("component", "place")).join(votes, "component", "left")
              .select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                      F.when(F.coalesce("allow", F.lit(False)), "allow").when(F.coalesce("block", F.lit(False)), "block")
                      .otherwise("allow").alias("verdict"), "component"))
    direct = ruled.join(named, F.col("place") == F.col("node"), "left").select(
        "page_id", "host", "path", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("verdict"),
        F.coalesce("component", "place").alias("component"))
    return direct.union(judged)


def _sql_host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"


def _sql_path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _sql_place(url: str) -> str:
    asked = f"regexp_extract({url}, '(?s)^[^?#]*\\?([^#]*)', 1)"
    kept = f"regexp_replace(regexp_replace({asked}, '{TRACKING}', '', 'g'), '^&', '')"
    return (f"CASE WHEN contains({url}, '://') THEN {_sql_host(url)} || regexp_replace({_sql_path(url)}, '/$', '') "
            f"|| CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END")


def _sql_found(tag: str, target: str) -> str:
    tag, target = tag.replace("'", "''"), target.replace("'", "''")
    # Segments are followed from left to right on the text itself: each .. takes the last one off.
    dots = ("list_reduce(list_prepend('', string_split(ltrim(regexp_replace({0}, '/[.][.]?$', '\\0/'), '/'), '/')), lambda done, part: "
            "CASE part WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || part END)")
    follow = f"CASE WHEN regexp_matches({{0}}, '/[.][.]?(/|$)') THEN {dots} ELSE {{0}} END"
    return f"""SELECT url AS from_url, CASE
    WHEN found = '' THEN NULL
    WHEN regexp_matches(found, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN regexp_matches(found, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN found END
    WHEN starts_with(found, '//') THEN 'http:' || found
    WHEN starts_with(found, '/') THEN 'http://' || h || ({follow.format("t")}) || q
    WHEN t = '' THEN 'http://' || h || p || CASE WHEN q <> '' THEN q ELSE regexp_extract(coalesce(url, ''), '(?s)^[^?#]*(\?[^#]*)', 1) END
    ELSE 'http://' || h || ({follow.format("beside")}) || q END AS to_url
  FROM (SELECT *, CASE WHEN p = '' THEN '/' ELSE regexp_extract(p, '(?s)^(.*/)', 1) END || t AS beside FROM (
    SELECT url, found, {_sql_host("url")} AS h, {_sql_path("url")} AS p, split_part(split_part(found, '#', 1), '?', 1) AS t,
      regexp_extract(found, '(?s)^[^?#]*(\?[^#]*)', 1) AS q FROM (
        SELECT url, replace(regexp_extract(regexp_extract(coalesce(html, ''), '{tag}', 0), '{target}', 1), '&amp;', '&') AS found FROM pages)))"""


def _sql_rule(column: str, host_: str, path_: str, rules: Sequence[tuple[str, str]] = RULES) -> str:
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        cases.append(f"WHEN ({host_} = '{name}' OR ends_with({host_}, '.{name}')) "
                     f"AND starts_with({path_}, '{slash + rest}') THEN '{rule if column == 'rule' else verdict}'")
    return f"CASE {' '.join(cases)} END"


ORACLE_SQL = f"""
WITH RECURSIVE hops AS (
  SELECT * FROM ({_sql_found(LINK, HREF)} UNION ALL {_sql_found(REFRESH, TARGET)})
  WHERE from_url IS NOT NULL AND to_url IS NOT NULL),
edges AS (SELECT {_sql_place('from_url')} AS a, {_sql_place('to_url')} AS b FROM hops),
ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, other) AS (
  SELECT a, a FROM ways UNION SELECT r.node, w.b FROM reach r JOIN ways w ON w.a = r.other),
named AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
seen AS (
  SELECT page_id, url FROM pages UNION ALL SELECT NULL, from_url FROM hops UNION ALL SELECT NULL, to_url FROM hops),
hosted AS (SELECT page_id, {_sql_host('url')} AS host, {_sql_path('url')} AS path, {_sql_place('url')} AS place FROM seen),
judged AS (
  SELECT page_id, host, path, {_sql_rule('rule', 'host', 'path')} AS rule, {_sql_rule('verdict', 'host', 'path')} AS own,
    coalesce(component, place) AS component
  FROM hosted LEFT JOIN named ON place = node),
votes AS (SELECT component, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM judged GROUP BY 1)
SELECT page_id, host, path, rule,
  coalesce(own, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, j.component
FROM judged j LEFT JOIN votes v ON v.component = j.component WHERE page_id IS NOT NULL
"""


@query("op9_url_filter", ORACLE_SQL)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
