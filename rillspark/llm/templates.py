"""URL filtering by a path-template tree.

Rules decide what they fit, and label it. All paths of a host then go down a tree together, a segment a level: values of a
segment that are rare among their siblings are variable and become wildcards (by the shape of their digits, or any), what
is left are branches, and branches whose labelled shares don't differ significantly are merged. A node's purity is the
share of blocked pages among its labelled ones, smoothed towards its parent's; pages of templates with a purity of REJECT
or more are blocked, where no rule tells otherwise.

A level counts values before it shuffles. A node has at most 2 / SHARE branches and one, so it is a row with two short maps,
which pages join by their node; nodes that hold a thousandth of all pages or more (a thousand of them at most) are broadcast.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The contract's rules: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Segments that a template has; the rest of a longer path is its tail.
DEPTH = 6
#: A value or shape is a branch if it has 1 / SHARE of its node's pages, and LEAST pages.
SHARE, LEAST = 20, 3
#: Branches differ if the squared z score of their labelled shares is above this (95 %).
DIFFERENT = 3.841458820694124
#: The weight of the parent's purity, in labelled pages, and the purity at which a template is rejected.
SMOOTH, REJECT = 4.0, 0.8
#: A node with 1 / HOT of all pages goes by broadcast.
HOT = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ://."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Of the rules that fit the longest one (host and path together; of equal ones the one with the longer host): its text and verdict."""
    text = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[1])):  # the longest is asked first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def shape(value: Column) -> Column:
    """What a rare value stands for: its text with digits as {n}, or anything."""
    return F.when(value.rlike("[0-9]"), F.regexp_replace(escaped(value), "[0-9]+", "{n}")).otherwise("*")


def escaped(value: Column) -> Column:
    """A literal segment, without the characters that templates use."""
    for c in "%{|}*":
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return value


def _attached(rows: DataFrame, nodes: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with their node's columns; those of hot nodes by broadcast."""
    keys, hot = ["host", "prefix"], F.broadcast(hot.select("host", "prefix"))
    large = rows.join(hot, keys, "left_semi").join(F.broadcast(nodes.join(hot, keys, "left_semi")), keys)
    return large.unionByName(rows.join(hot, keys, "left_anti").join(nodes.join(hot, keys, "left_anti"), keys))


def _children(values: DataFrame) -> DataFrame:
    """host, prefix, kind, name, l, b, purity, of all branches; values has a node's pages (total) with each value (n, l, b)."""
    by, common = ["host", "prefix"], lambda name: F.col(name) * SHARE >= F.col("total")
    summed = [F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"), F.max("total").alias("total"), F.max("purity").alias("purity")]
    literal = common("n") & (F.col("n") >= LEAST)
    named = values.select(*by, F.when(literal, "literal").otherwise("shape").alias("kind"), F.when(literal, F.col("value")).otherwise(shape(F.col("value"))).alias("name"), "n", "l", "b", "total", "purity")
    shapes = named.groupBy(*by, "kind", "name").agg(*summed)
    kept = (F.col("kind") == "literal") | common("n") & (F.col("n") >= LEAST) & (F.col("name") != "*")
    return shapes.withColumn("kind", F.when(kept, F.col("kind")).otherwise("any")).withColumn("name", F.when(kept, F.col("name")).otherwise("*")).groupBy(*by, "kind", "name").agg(*summed)


def _merged(children: DataFrame) -> DataFrame:
    """host, prefix, literals, shapes, other: each node's branches after merging, as maps from a name to (branch, purity)."""
    d = lambda c: F.col(c).cast("double")
    smooth = lambda l, b: (b + F.lit(SMOOTH) * F.col("purity")) / (l + F.lit(SMOOTH))  # noqa: E731, E741
    order = Window.partitionBy("host", "prefix").orderBy("s", "kind", "name")
    rated = children.withColumn("s", smooth(d("l"), d("b"))).select("*", F.lag("l").over(order).cast("double").alias("l0"), F.lag("b").over(order).cast("double").alias("b0"))
    lone, pooled, bad = d("b") * F.col("l0") - F.col("b0") * d("l"), d("l") + F.col("l0"), d("b") + F.col("b0")
    similar = F.when((F.col("l") == 0) | (F.col("l0") == 0), F.col("l") == F.col("l0")).otherwise(lone * lone * pooled <= F.lit(DIFFERENT) * d("l") * F.col("l0") * bad * (pooled - bad))
    grouped = rated.withColumn("first", F.when(F.coalesce(similar, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("first").over(order))
    own = Window.partitionBy("host", "prefix", "part")
    label = F.when(F.col("kind") == "literal", escaped(F.col("name"))).otherwise(F.col("name"))
    members = F.array_sort(F.collect_list(label).over(own))
    named = F.when(F.size("members") == 1, F.col("members")[0]).otherwise(F.concat(F.lit("{"), F.array_join("members", "|"), F.lit("}")))
    whole = grouped.withColumn("members", members).withColumn("branch", F.struct(named.alias("branch"), smooth(F.sum("l").over(own).cast("double"), F.sum("b").over(own).cast("double")).alias("purity")))
    entry = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "branch"))))
    return whole.groupBy("host", "prefix").agg(entry("literal").alias("literals"), entry("shape").alias("shapes"), F.max(F.when(F.col("kind") == "any", F.col("branch"))).alias("other"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, depth: int = DEPTH) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, template, purity.

    rules: (verdict, host, path), a short list. A null url, and one without ://, has an empty host, path and template. Empty
    segments aren't looked at; very long paths have a tail beyond depth segments. Page ids may be null or repeated; each row
    is judged. Without any labelled page, purity is a half and everything without a rule is allowed. An empty table gives no
    rows. Other columns aren't looked at.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("verdict"))
    rows = written(rows.withColumn("prefix", F.lit("")), "url-rows")
    l, b = F.count("verdict").alias("l"), F.count_if(F.col("verdict") == "block").alias("b")  # noqa: E741
    all_ = rows.agg(F.count("*").alias("n"), l, b).first()
    root = (all_["b"] + 1.0) / (all_["l"] + 2.0)
    hot = lambda totals: totals.filter(F.col("n") * HOT >= all_["n"])  # noqa: E731  at most HOT nodes
    hosts = written(rows.groupBy("host", "prefix").agg(F.count("*").alias("n"), l, b), "url-hosts")
    rated = hosts.select("host", "prefix", ((F.col("b") + F.lit(SMOOTH) * F.lit(root)) / (F.col("l") + F.lit(SMOOTH))).alias("purity"))
    rows, done = _attached(rows, rated, hot(hosts)), []
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    for level in range(depth):
        rows = written(rows, "url-rows")
        done.append(rows.filter(F.size(segments) <= level))
        rows = rows.filter(F.size(segments) > level).withColumn("value", F.get(segments, F.lit(level)))
        totals = written(rows.groupBy("host", "prefix").agg(F.count("*").alias("n"), F.max("purity").alias("purity")), "url-nodes")
        if totals.isEmpty():
            break
        large = hot(totals)
        values = written(rows.groupBy("host", "prefix", "value").agg(F.count("*").alias("n"), l, b), "url-values")
        children = _children(_attached(values, totals.withColumnRenamed("n", "total"), large))
        nodes = written(_merged(children), "url-branches")
        found = F.coalesce(F.try_element_at("literals", F.col("value")), F.try_element_at("shapes", shape(F.col("value"))), F.col("other"))
        rows = _attached(rows.drop("purity"), nodes, large).withColumn("found", found)
        rows = rows.select("page_id", "host", "path", "rule", "verdict", F.concat("prefix", F.lit("/"), "found.branch").alias("prefix"), "found.purity")
    else:
        tail = F.when(F.size(segments) > depth, F.concat("prefix", F.lit("/**"))).otherwise(F.col("prefix"))
        done.append(rows.withColumn("prefix", tail))
    out = functools.reduce(DataFrame.unionByName, [d.select("page_id", "host", "path", "rule", "verdict", "prefix", "purity") for d in done])
    judged = F.coalesce("verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", judged.alias("verdict"), F.col("prefix").alias("template"), F.round("purity", 6).alias("purity"))


def _sql_rules() -> tuple[str, str]:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return tuple("CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{x}'" for k, h, p in longest for x in [h + p if i == 0 else k]) + " END" for i in range(2))


def _sql_level(i: int) -> str:
    """CTEs that take the rows of level i, r{i}, down to level i + 1."""
    at = f"seg[{i + 1}]"
    plain = functools.reduce(lambda v, c: f"replace({v}, '{c}', '%{ord(c):02X}')", "%{|}*", "value")
    shaped = f"CASE WHEN regexp_matches(value, '[0-9]') THEN regexp_replace({plain}, '[0-9]+', '{{n}}', 'g') ELSE '*' END"
    sums = "sum(n) AS n, sum(l) AS l, sum(b) AS b, max(total) AS total, max(purity) AS purity"
    return f"""
v{i} AS MATERIALIZED (SELECT host, prefix, {at} AS value, count(*) AS n, count(verdict) AS l, count(*) FILTER (verdict = 'block') AS b, max(purity) AS purity FROM r{i} WHERE len(seg) > {i} GROUP BY ALL),
k{i} AS (SELECT *, sum(n) OVER (PARTITION BY host, prefix) AS total FROM v{i}),
n{i} AS (SELECT host, prefix, value, CASE WHEN n * {SHARE} >= total AND n >= {LEAST} THEN 'literal' ELSE 'shape' END AS kind, CASE WHEN kind = 'literal' THEN value ELSE {shaped} END AS name, n, l, b, total, purity FROM k{i}),
s{i} AS MATERIALIZED (SELECT host, prefix, kind, name, {sums} FROM n{i} GROUP BY ALL),
a{i} AS (SELECT *, kind = 'literal' OR (n * {SHARE} >= total AND n >= {LEAST} AND name <> '*') AS kept FROM s{i}),
c{i} AS MATERIALIZED (SELECT host, prefix, CASE WHEN kept THEN kind ELSE 'any' END AS kind2, CASE WHEN kept THEN name ELSE '*' END AS name2, {sums} FROM a{i} GROUP BY ALL),
e{i} AS (SELECT *, (b + {SMOOTH} * purity) / (l + {SMOOTH}) AS s FROM c{i}),
f{i} AS (SELECT *, lag(l::DOUBLE) OVER w AS l0, lag(b::DOUBLE) OVER w AS b0 FROM e{i} WINDOW w AS (PARTITION BY host, prefix ORDER BY s, kind2, name2)),
g{i} AS (SELECT *, CASE WHEN l0 IS NULL THEN false WHEN l = 0 OR l0 = 0 THEN l = l0
  ELSE (b::DOUBLE * l0 - b0 * l::DOUBLE) * (b::DOUBLE * l0 - b0 * l::DOUBLE) * (l::DOUBLE + l0) <= {DIFFERENT} * l::DOUBLE * l0 * (b::DOUBLE + b0) * ((l::DOUBLE + l0) - (b::DOUBLE + b0)) END AS alike FROM f{i}),
h{i} AS (SELECT *, sum(CASE WHEN alike THEN 0 ELSE 1 END) OVER (PARTITION BY host, prefix ORDER BY s, kind2, name2) AS part FROM g{i}),
m{i} AS MATERIALIZED (SELECT host, prefix, kind2, name2, (sum(b) OVER w + {SMOOTH} * purity) / (sum(l) OVER w + {SMOOTH}) AS p,
  list_sort(list(CASE WHEN kind2 = 'literal' THEN {plain.replace("value", "name2")} ELSE name2 END) OVER w) AS members FROM h{i} WINDOW w AS (PARTITION BY host, prefix, part)),
x{i} AS (SELECT n.host, n.prefix, n.value, CASE WHEN len(m.members) = 1 THEN m.members[1] ELSE '{{' || array_to_string(m.members, '|') || '}}' END AS branch, m.p FROM n{i} n
  JOIN a{i} a ON a.host = n.host AND a.prefix = n.prefix AND a.kind = n.kind AND a.name = n.name
  JOIN m{i} m ON m.host = n.host AND m.prefix = n.prefix AND m.kind2 = CASE WHEN a.kept THEN a.kind ELSE 'any' END AND m.name2 = CASE WHEN a.kept THEN a.name ELSE '*' END),
r{i + 1} AS MATERIALIZED (SELECT r.page_id, r.host, r.path, r.rule, r.verdict, r.seg, CASE WHEN x.branch IS NULL THEN r.prefix ELSE r.prefix || '/' || x.branch END AS prefix, coalesce(x.p, r.purity) AS purity
  FROM r{i} r LEFT JOIN x{i} x ON len(r.seg) > {i} AND x.host = r.host AND x.prefix = r.prefix AND x.value = r.{at})"""


_RULE, _VERDICT = _sql_rules()
ORACLE = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
j AS MATERIALIZED (SELECT *, {_RULE} AS rule, {_VERDICT} AS verdict, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg FROM u),
t AS MATERIALIZED (SELECT (count(*) FILTER (verdict = 'block') + 1.0::DOUBLE) / (count(verdict) + 2.0::DOUBLE) AS root FROM j),
q AS MATERIALIZED (SELECT host, (count(*) FILTER (verdict = 'block') + {SMOOTH}::DOUBLE * max(root)) / (count(verdict) + {SMOOTH}::DOUBLE) AS purity FROM j, t GROUP BY 1),
r0 AS MATERIALIZED (SELECT page_id, host, path, rule, verdict, seg, '' AS prefix, purity FROM j JOIN q USING (host)),{",".join(_sql_level(i) for i in range(DEPTH))}
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN len(seg) > {DEPTH} THEN prefix || '/**' ELSE prefix END AS template, round(purity, 6) AS purity FROM r{DEPTH}
"""
