"""URL filters by host-suffix and path-prefix expressions.

A URL is put into canonical form and expanded into expressions: the host as it is and its suffixes, each
with the path and query, the path, and the path's prefixes; suffixes and prefixes are as deep as the deepest rule has labels and segments. A rule is such an expression. Both sides are hashed with
SHA-256; they meet in an equi-join on the first PREFIX_BYTES bytes of the digest, and what meets there is confirmed by the full digests afterwards: rules that share a prefix are one row, an array of
candidates, in which each expression looks for its own digest. Of the rules that a URL meets the one of highest
priority decides; among equals the more specific one (longer host, then longer path), then "allow" before "block", then the smaller rule_id.

The rules of one expression come down to one (the first by priority, action and rule_id, which is the order that would decide between them), so a prefix has as many candidates
as there are different expressions that share it: one, but for one in 2^(8 * PREFIX_BYTES) pairs.

Cost: only the URL column is read; a URL gives at most (labels of the deepest rule) * (segments of the deepest rule + 3) short rows, of a 4-byte prefix and the digest,
and the rules have one each. Up to BROADCAST_RULES rules go to every task; of more, both sides are shuffled by prefix. Equal URLs are expanded once: pages of
a URL find their verdict by a join on it.

Canonical form: white space around the URL and control characters go, the scheme is dropped, likewise user, port and fragment; the host is in lower case without leading or trailing dots, the
path begins with "/", runs of "/" are one, "/./" and "/x/../" are resolved.

Defined cases: a null URL, or one without a host, meets no rule: action "none". A host that is an IPv4 address has no suffixes. Rules with a null pattern or action are left out; repeated rules are harmless. Very long
URLs are expanded like others, the prefixes being bounded by the rules' depth. Repeated page ids each get a row. An empty table of either side gives a defined result. Columns other than those named don't matter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_BYTES = 4
#: Rules up to this number are sent to every task.
BROADCAST_RULES = 200_000
#: Depths that do for RULES, used in VERDICTS_SQL; url_verdicts takes them from the rules that it is given.
MAX_SUFFIX = 4
MAX_PREFIX = 4
#: (rule_id, pattern, action, priority): lists as an operator would keep them, by kind of host; a hosted path may be let through again.
RULES = [
    (1, "spam-farm.example.org", "block", 10),
    (2, "cheap-pills.example.com", "block", 10),
    (3, "adult-x.example.net", "block", 10),
    (4, "ads-track.example.org", "block", 10),
    (5, "casino-win.example.com", "block", 10),
    (6, "malware-host.example.net", "block", 20),
    (7, "blog.tionsh.example.net/en/", "block", 5),
    (8, "tionsh.example.net", "allow", 5),
    (9, "example.org/de/", "block", 1),
    (10, "thther.example.org", "allow", 1),
    (11, "spam-farm.example.org/en/", "allow", 5),
    (12, "example.com/fr/825?page=2&ref=x", "block", 30),
]
_RULE = "rule_id long, pattern string, action string, priority int"


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, _RULE)


def canonical(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query with its question mark or ""); host is null where there is none."""
    u = F.regexp_replace(url.cast("string"), r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
    u = F.regexp_replace(F.regexp_replace(u, r"#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*|^//", "")
    host = F.regexp_extract(u, r"^([^/?]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""))
    host = F.regexp_replace(F.regexp_replace(host, r"\.{2,}", "."), r"^\.|\.$", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"(\?.*)$", 1)
    path = F.regexp_replace(F.concat(F.lit("/"), path), r"/{2,}", "/")
    path = F.when(path.rlike(r"/\.\.?(/|$)"), _resolved(path)).otherwise(path)
    return F.nullif(host, F.lit("")), path, query


def _resolved(path: Column) -> Column:
    """Without the segments "." and "..", segment by segment: a regular expression would recurse on long paths."""
    segments = F.slice(F.split(path, "/"), 2, 1 << 30)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    end = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))


class Depths(NamedTuple):
    labels: int
    segments: int
    rules: int


def depths(rules: DataFrame) -> Depths:
    """Labels of the deepest host and segments of the deepest path prefix among rules (host, path, query), and their number; a prefix of k segments counts its leading slash as one."""
    prefix = F.when((F.col("query") == "") & F.col("path").endswith("/"), F.size(F.split("path", "/")) - 1)
    labels, segments, n = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(prefix), F.count("*")).first()
    return Depths(max(labels or 0, 2), max(segments or 0, 1), n)


def expressions(host: Column, path: Column, query: Column, most_labels: int, most_segments: int) -> Column:
    """array<struct<host, rest>> of a canonical URL."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.filter(F.sequence(F.lit(2), F.lit(most_labels)), lambda k: k < n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    hosts = F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.array(host)).otherwise(F.array_distinct(F.concat(F.array(host), suffixes)))
    segments = F.split(path, "/")
    # "/", "/a/", "/a/b/", ...: prefixes that end with a slash
    prefixes = F.transform(F.filter(F.sequence(F.lit(1), F.lit(most_segments)), lambda k: k < F.size(segments)), lambda k: F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/")))
    rests = F.array_distinct(F.concat(F.array(F.concat(path, query)), F.array(path), prefixes))
    return F.when(host.isNotNull(), F.flatten(F.transform(hosts, lambda h: F.transform(rests, lambda r: F.struct(h.alias("host"), r.alias("rest"))))))


def _digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def url_verdicts(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """(page_id, url, action, rule_id, matched): the deciding rule of each page, with the expression it matched."""
    seen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path, query = canonical(F.col("url"))
    # few bytes and much work follow: as many tasks as the session has for a shuffle, whatever the size
    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = seen.select("url").where("url IS NOT NULL").distinct().repartition(spread, F.xxhash64("url")).select("url", host.alias("host"), path.alias("path"), query.alias("query"))
    known = rules.where("pattern IS NOT NULL AND action IS NOT NULL")
    host, path, query = canonical(F.col("pattern"))
    known = known.select("rule_id", F.lower("action").alias("action"), F.coalesce("priority", F.lit(0)).alias("priority"), host.alias("host"), path.alias("path"), query.alias("query")).where("host IS NOT NULL")
    deep = depths(known)
    known = known.select(_digest(F.concat("host", "path", "query")).alias("digest"), "rule_id", "action", "priority")
    known = known.groupBy("digest").agg(F.min_by(F.struct("digest", "rule_id", "action", "priority"), F.struct(-F.col("priority"), "action", "rule_id")).alias("r"))
    known = known.groupBy(F.substring("digest", 1, prefix_bytes).alias("rule_prefix")).agg(F.collect_list("r").alias("candidates"))
    # a rule takes about 100 bytes; more of them than that meet the URLs in a merge join
    known = F.broadcast(known) if deep.rules <= BROADCAST_RULES else known.hint("merge")
    expanded = parts.select("url", F.explode(expressions(F.col("host"), F.col("path"), F.col("query"), deep.labels, deep.segments)).alias("e")).select("url", F.concat("e.host", "e.rest").alias("expression"), F.length("e.host").alias("host_length"))
    expanded = expanded.withColumn("digest", _digest(F.col("expression"))).withColumn("prefix", F.substring("digest", 1, prefix_bytes))
    met = expanded.join(known, F.col("prefix") == F.col("rule_prefix"))
    met = met.select("url", "expression", "host_length", F.explode(F.filter("candidates", lambda c: c["digest"] == F.col("digest"))).alias("r")).select("url", "expression", "host_length", "r.rule_id", "r.action", "r.priority")
    order = F.struct(-F.col("priority"), -F.col("host_length"), -F.length("expression"), F.col("action"), F.col("rule_id"))
    best = met.groupBy(F.col("url").alias("_url")).agg(F.min_by(F.struct("action", "rule_id", "expression"), order).alias("b"))
    return seen.join(best, seen["url"] == best["_url"], "left").select("page_id", "url", F.coalesce("b.action", F.lit("none")).alias("action"), F.col("b.rule_id").alias("rule_id"), F.col("b.expression").alias("matched"))


def url_filter(pages: DataFrame, rules: DataFrame, *, url_col: str = "url") -> DataFrame:
    """pages without those whose verdict is "block"."""
    slim = pages.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct().select(F.col("url").alias("page_id"), "url")
    bad = url_verdicts(slim, rules).where("action = 'block'").select(F.col("url").alias("_blocked_url"))
    return pages.join(bad, pages[url_col] == bad["_blocked_url"], "left_anti")


_VALUES = ", ".join(f"({i}, '{p}', '{a}', {k})" for i, p, a, k in RULES)


def _sql_parts(column: str, table: str, more: str) -> str:
    return f"""
  SELECT {more}, {column}, nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(u, '^([^/?]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\\.{{2,}}', '.', 'g'), '^\\.|\\.$', '', 'g'), '') AS host,
    regexp_replace(regexp_replace('/' || regexp_extract(regexp_replace(u, '^[^/?]*', ''), '^([^?]*)', 1), '/{{2,}}', '/', 'g'), '(/\\.)+(/|$)', '/', 'g') AS path,
    regexp_extract(regexp_replace(u, '^[^/?]*', ''), '(\\?.*)$', 1) AS query
  FROM (SELECT *, regexp_replace(regexp_replace(trim({column}), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*:/*|^//', '') AS u FROM {table} WHERE {column} IS NOT NULL)"""


VERDICTS_SQL = f"""
WITH rules(rule_id, pattern, action, priority) AS (VALUES {_VALUES}),
r AS (SELECT rule_id, action, priority, host || path || query AS expression FROM ({_sql_parts("pattern", "rules", "rule_id, action, priority")})),
c AS ({_sql_parts("url", "(SELECT DISTINCT url FROM pages)", "1 AS one")}),
h AS (
  SELECT url, path, query, unnest(CASE WHEN regexp_matches(host, '^[0-9]+(\\.[0-9]+){{3}}$') THEN [host] ELSE list_distinct(list_concat([host],
    list_transform(list_filter(range(2, {MAX_SUFFIX + 2}), lambda k: k < len(string_split(host, '.'))), lambda k: array_to_string(string_split(host, '.')[len(string_split(host, '.')) - k + 1:], '.')))) END) AS host
  FROM c WHERE host IS NOT NULL
), e AS (
  SELECT url, host, unnest(list_distinct(list_concat([path || query, path],
    list_transform(list_filter(range(1, {MAX_PREFIX + 1}), lambda k: k < len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/') || '/')))) AS rest
  FROM h
), m AS (
  SELECT url, r.action, r.rule_id, r.expression, row_number() OVER (PARTITION BY url ORDER BY priority DESC, length(host) DESC, length(r.expression) DESC, r.action, r.rule_id) AS k
  FROM e JOIN r ON sha256(e.host || e.rest) = sha256(r.expression)
)
SELECT p.page_id, p.url, coalesce(m.action, 'none') AS action, m.rule_id, m.expression AS matched FROM pages p LEFT JOIN m ON p.url = m.url AND m.k = 1
"""
