"""URL filter with redirect equivalence.

Rules of host and path judge urls: a rule fits its host and all subdomains where the url's path starts with the
rule's, and the longest rule wins (of equal length, one that allows). Host suffixes are joined to the rules' hosts, so
any number of rules is one equi-join; both sides are salted, as a third of all urls may share a suffix.

Canonical links and client redirects of a page are edges between urls. Over their connected components, a block of
any url, page or only link target, reaches the aliases for which no rule is found. Explicit allowance has precedence
at the url that it names: an allowing rule shields its url from the blocks of aliases, and no other url.

Link targets are read as browsers read them: character references are decoded, and relative targets are resolved
against the page's url. Nodes are host, path without dot segments, and query.

Defined results: null urls and urls without ``://`` have empty host and path and no rule or alias, and are allowed;
null html has no links; equal urls are one node; repeated rows get equal results; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.llm.common import components, cut, table

# Rules as (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_path(path: Column) -> Column:
    """A path without dot segments; an empty one is the root."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    known = F.aggregate(
        F.slice(segments, 2, F.size(segments)),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s)),
    )
    ends = F.when(last.isin(".", ".."), F.when(F.size(known) > 0, "/").otherwise("")).otherwise("")
    return F.when(path == "", "/").when(~path.contains("/."), path).otherwise(F.concat(F.lit("/"), F.array_join(known, "/"), ends))


def address(url: Column) -> Column:
    """The node of a url: host, path and query, without scheme and fragment; null without ``://``."""
    host, path = parts(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host, plain_path(path), query))


def decoded(text: Column) -> Column:
    """The text with the character references that a url may hold resolved."""
    for name, char in ((r"&(?:quot|#34|#x22);", '"'), (r"&(?:apos|#39|#x27);", "'"), (r"&(?:lt|#60|#x3C);", "<"), (r"&(?:gt|#62|#x3E);", ">"), (r"&(?:sol|#47|#x2F);", "/"), (r"&(?:amp|#38|#x26);", "&")):
        text = F.regexp_replace(text, f"(?i){name}", char)
    return text


def resolved(target: Column, url: Column) -> Column:
    """A link target as a url: absolute ones as they are, others by the url of their page."""
    scheme, root = F.regexp_extract(url, r"(?s)^([^/?#]*:)//", 1), F.regexp_extract(url, r"(?s)^([^/?#]*://[^/?#]*)", 1)
    page, folder = F.regexp_extract(url, r"(?s)^([^?#]*)", 1), F.regexp_extract(url, r"(?s)^[^/?#]*://[^/?#]*(/(?:[^?#]*/)?)", 1)
    kinds = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(target.startswith("//"), F.concat(scheme, target)).when(target.startswith("/"), F.concat(root, target))
    kinds = kinds.when(target.startswith("?"), F.concat(page, target)).when(target.startswith("#"), url)
    return kinds.otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(key, rule, rule_verdict)`` of the distinct ``(key, host, path)`` for which a rule is found."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffix = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    salted = urls.withColumns({"rule_host": F.explode(suffix), "salt": F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")})
    spread = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fits = salted.join(spread, ["rule_host", "salt"]).filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("length"), (F.col("rule_verdict") == "allow").alias("allows"), rule.alias("rule"), F.col("rule_verdict")))
    return fits.groupBy("key").agg(best.alias("best")).select("key", "best.rule", "best.rule_verdict")


def links(pages: DataFrame) -> DataFrame:
    """``(url, target)``: canonical links and refresh targets of pages, as urls."""
    found = pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv")).select(
        "url", F.explode(F.concat(F.regexp_extract_all("html", F.lit(CANONICAL), 1), F.regexp_extract_all("html", F.lit(REFRESH), 1))).alias("target")
    )
    return found.select("url", resolved(decoded(F.col("target")), F.col("url")).alias("target"))


def keyed(df: DataFrame, url: str) -> DataFrame:
    """Adds ``node, host, path`` of a url, and ``key``, the part of it that rules read."""
    host, path = parts(F.col(url))
    return df.withColumns({"node": address(F.col(url)), "host": host, "path": path, "key": F.concat_ws("\n", host, path)})


def url_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every page.

    What is joined grows with the pages, so no side is broadcast but the rules, if they are small.
    """
    linked = cut(links(pages))
    edges = linked.select(address(F.col("url")).alias("a"), address(F.col("target")).alias("b")).filter("a is not null and b is not null")
    roots = cut(components(edges))
    own = keyed(pages.select("page_id", "url"), "url").drop("url")
    names = ["node", "host", "path", "key"]
    urls = own.select(*names).union(keyed(linked.select("target"), "target").select(*names)).filter("node is not null")
    decided = cut(matched(urls.select("key", "host", "path").distinct(), rules))
    members = roots.join(urls.select("node", "key").distinct().hint("merge"), "node")  # all urls of components, as pages or targets
    blocks = members.join(decided.filter("rule_verdict = 'block'").select("key").hint("merge"), "key").select("root").distinct()
    blocked = roots.join(blocks.hint("merge"), "root").select(F.col("node").alias("blocked_node"))
    judged = own.join(decided.hint("merge"), "key", "left").join(blocked.hint("merge"), F.col("node") == F.col("blocked_node"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked_node").isNotNull(), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), rule_table(spark))


#: Of links, the SQL reads canonical ones with an absolute target; the tables have none of the other kinds.
OP2_SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, url, html, contains(url, '://') AS whole, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t(rule_host, rule_path, rule_verdict)),
f AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS told
      FROM q JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1),
e AS (SELECT url AS a, regexp_extract(html, '(?i)<link[^>]*rel=.?canonical[^>]*href=["'']?([a-z]+://[^"''\s>]+)', 1) AS b FROM pages WHERE regexp_matches(html, '(?i)canonical')),
s AS (SELECT a, b FROM e WHERE b <> '' UNION SELECT b, a FROM e WHERE b <> ''),
reach AS (SELECT a AS url, a AS other FROM s UNION SELECT reach.url, s.b FROM reach JOIN s ON reach.other = s.a),
bad AS (SELECT DISTINCT reach.url FROM reach JOIN q ON q.url = reach.other JOIN f ON f.page_id = q.page_id WHERE f.told = 'block')
SELECT q.page_id, coalesce(q.host, '') AS host, coalesce(q.path, '') AS path, f.rule, coalesce(f.told, CASE WHEN bad.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN f ON q.page_id = f.page_id LEFT JOIN bad ON q.url = bad.url
"""
