"""URL filter with redirect equivalence.

Rules name a host (with all its subdomains) and a path prefix; the longest fitting rule decides. Urls without a rule
take the decision of their equivalence class: the connected component over redirects and canonical links. A class with
an explicitly blocked url is blocked, unless it also holds an explicitly allowed one: an explicit allow takes precedence.
Only DataFrame functions are used.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, is no node and is allowed. A
page without html has no edges. Repeated pages are all judged, alike. Edges may name urls that are no page; their rules
count for their class. Of two rules with the same text the allow counts. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.llm.common import table
from thinjoin.llm.components import components
from thinjoin.session import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Start tags that state where a page lives or leads to.
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
#: A scheme and its separator; one further on, in a query, makes no absolute url.
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """128-bit key of a url without scheme and fragment; null for what is no absolute url."""
    query = F.regexp_extract(url, "://[^?#]*(\\?[^#]*)", 1)
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(host_of(url) != "", F.md5(F.concat(host_of(url), path, query)))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(text, allow) of the longest fitting rule, else null. One expression: meant for up to some hundreds of rules."""
    chosen = F.lit(None).cast("struct<text: string, allow: boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.allow)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.allow).alias("allow"))).otherwise(chosen)
    return chosen


def absolute(target: Column, base: Column) -> Column:
    """``target`` as named on the page ``base``."""
    site = F.regexp_extract(base, "^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([^:]*://[^?#]*/)", 1)
    return (
        F.when(target.rlike(ABSOLUTE), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(F.when(folder.rlike("://.*/"), folder).otherwise(F.concat(site, F.lit("/"))), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(source, target) urls of the canonical links and redirects that pages state."""
    tags = F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all("html", F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, TARGET, 1)),
    )
    stated = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select(
        F.col("url").alias("source"), F.explode(tags).alias("named")
    )
    named = F.replace("named", F.lit("&amp;"), F.lit("&"))
    return stated.where(F.col("named") != "").select("source", absolute(named, F.col("source")).alias("target"))


def blocked_nodes(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The nodes of classes that hold a blocked url and no allowed one."""
    ends = [F.struct(node_of(F.col(c)).alias("node"), longest_rule(host_of(F.col(c)), path_of(F.col(c)), rules)["allow"].alias("allow")) for c in ("source", "target")]
    ends = settle(edges.select(ends[0].alias("s"), ends[1].alias("t")), "alias-edges")
    classes = components(ends.select(F.col("s.node").alias("a"), F.col("t.node").alias("b")))
    ruled = ends.select("s.*").unionByName(ends.select("t.*")).where(F.col("allow").isNotNull()).distinct()
    verdicts = classes.join(ruled, "node").groupBy("component").agg(F.bool_or("allow").alias("allowed"))
    return classes.join(verdicts.where(~F.col("allowed")), "component").select("node")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, reason) for every row of ``pages`` (page_id, url, html).

    ``edges`` (source, target) are redirects seen elsewhere, such as in a crawl log; they join those the pages state.
    """
    stated = alias_edges(pages)
    if edges is not None:
        stated = stated.unionByName(edges.select("source", "target"))
    blocked = settle(blocked_nodes(stated, rules), "blocked-nodes").withColumnRenamed("node", "blocked")
    url = F.col("url")
    judged = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = judged.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    judged = judged.join(blocked, F.col("node") == F.col("blocked"), "left")
    allow = F.coalesce("found.allow", F.col("blocked").isNull())
    reason = F.when(F.col("found").isNotNull(), "rule").when(F.col("blocked").isNotNull(), "class").otherwise("none")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("found.text").alias("rule"),
        F.when(allow, "allow").otherwise("block").alias("verdict"),
        reason.alias("reason"),
    )


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))


def _sql() -> str:
    lower = f"'{UPPER}', '{UPPER.lower()}'"

    def parts(url: str) -> tuple[str, str, str]:
        host = f"translate(coalesce(regexp_extract({url}, '://([^/?#]*)', 1), ''), {lower})"
        path = f"coalesce(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), '')"
        query = f"regexp_extract({url}, '://[^?#]*(\\?[^#]*)', 1)"
        return host, path, f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {query} END"

    def rule(host: str, path: str, what: str) -> str:
        whens = "".join(
            f" WHEN ({host} = '{r.host}' OR {host} LIKE '%.{r.host}') AND starts_with({path}, '{r.path}') THEN "
            + (f"'{r.text}'" if what == "text" else str(r.allow).lower())
            for r in sorted(RULES, key=lambda r: (-len(r.text), not r.allow))
        )
        return f"(CASE{whens} END)"

    host, path, node = parts("url")
    q = lambda pattern: pattern.replace("'", "''")
    ends = {c: parts(c) for c in ("source", "target")}
    nodes = " UNION ".join(
        f"SELECT {n} AS node, {rule(h, p, 'allow')} AS allow FROM edges" for h, p, n in ends.values()
    )
    return f"""
WITH RECURSIVE edges AS (
  SELECT url AS source, CASE WHEN regexp_matches(t, '{ABSOLUTE}') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:]*:)', 1) || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || t
    WHEN regexp_matches(regexp_extract(url, '^([^:]*://[^?#]*/)', 1), '://.*/') THEN regexp_extract(url, '^([^:]*://[^?#]*/)', 1) || t
    ELSE regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || '/' || t END AS target
  FROM (SELECT url, replace(t, '&amp;', '&') AS t FROM (
        SELECT url, regexp_extract(unnest(regexp_extract_all(html, '{q(CANONICAL)}')), '{q(HREF)}', 1) AS t FROM pages
        UNION ALL SELECT url, regexp_extract(unnest(regexp_extract_all(html, '{q(REFRESH)}')), '{q(TARGET)}', 1) FROM pages))
  WHERE t <> '' AND url IS NOT NULL
), nodes AS ({nodes}), pairs AS (
  SELECT {ends['source'][2]} AS a, {ends['target'][2]} AS b FROM edges
  UNION SELECT {ends['target'][2]}, {ends['source'][2]} FROM edges
), reach AS (
  SELECT node AS a, node AS b FROM nodes WHERE node IS NOT NULL
  UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), classes AS (
  SELECT reach.a AS node, bool_or(allow) AS allowed FROM reach JOIN nodes ON reach.b = nodes.node GROUP BY reach.a
), judged AS (
  SELECT page_id, {host} AS host, {path} AS path, {node} AS node FROM pages
), ruled AS (
  SELECT judged.*, {rule('host', 'path', 'text')} AS rule, {rule('host', 'path', 'allow')} AS allow, NOT coalesce(allowed, true) AS blocked
  FROM judged LEFT JOIN classes USING (node)
)
SELECT page_id, host, path, rule, CASE WHEN coalesce(allow, NOT blocked) THEN 'allow' ELSE 'block' END AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN blocked THEN 'class' ELSE 'none' END AS reason
FROM ruled
"""


ORACLE = _sql()
