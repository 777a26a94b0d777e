"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger says which blob has been scanned
under which rule version; only pairs that it lacks are scanned, each blob once however many paths hold it, and findings
are joined back to all paths.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has at least so many characters; its end is exclusive."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()[:16]


#: The three base rules, in the order in which their spans are listed. Runs of hex digits and of key characters are
#: matched with their least length at once, which finds the same spans as matching all runs and dropping short ones.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = BASE + MORE
LEDGER = "blob string, rule string, findings array<struct<start:bigint,k:int,stop:bigint>>"


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rule, k (place of the rule), start, stop of every match, for blobs with text and todo (their rule versions).

    Spark gives a pattern's matches and what lies between them; positions are the running sum of both lengths.
    """
    made = []
    for k, r in enumerate(rules):
        p = F.lit(r.pattern)
        there = F.array_contains("todo", r.version) & F.col("text").rlike(r.pattern)
        zipped = F.arrays_zip(
            F.transform(F.split("text", r.pattern, -1), F.length).alias("gap"),
            F.transform(F.regexp_extract_all("text", p, F.lit(0)), F.length).alias("n"),
            F.transform(F.regexp_extract_all("text", p, F.lit(r.group)), F.length).alias("v"),
        )
        made.append(F.when(there, F.struct(F.lit(k).alias("k"), F.lit(r.version).alias("rule"), F.lit(r.least).alias("least"), zipped.alias("m"))))
    rows = blobs.select("blob", F.explode(F.array(*made)).alias("r")).filter("r is not null").select("blob", "r.k", "r.rule", "r.least", F.posexplode("r.m").alias("i", "x"))
    w = Window.partitionBy("blob", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("blob", "k", "rule", "least", "x.n", "x.v", (F.sum(F.col("x.gap") + F.coalesce("x.n", F.lit(0))).over(w)).alias("stop"))
    return rows.filter("n is not null and v >= least").select("blob", "rule", "k", (F.col("stop") - F.col("n")).cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows to add for versions (doc_id, text, blob): one for each pair of blob and rule version not in ledger."""
    versions = versions.withColumn("row", F.xxhash64("doc_id", "blob"))
    first = versions.groupBy("blob").agg(F.min("row").alias("row"))
    pairs = first.withColumn("rule", F.explode(F.array(*[F.lit(r.version) for r in rules])))
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "rule").distinct(), ["blob", "rule"], "left_anti")
    todo = written(pairs.groupBy("blob").agg(F.first("row").alias("_row"), F.collect_set("rule").alias("todo")).withColumnRenamed("blob", "_blob"), "ledger-todo")
    # the rows of one path of each unseen blob bring its text; the hashes, not the texts, are built into a hash table
    unseen = versions.join(todo.hint("shuffle_hash"), (versions["row"] == todo["_row"]) & (versions["blob"] == todo["_blob"]))
    # rows that repeat a path and its text are one version; they're in the same partition already
    unseen = unseen.dropDuplicates(["row", "blob"])
    found = scan(unseen.select("blob", "text", "todo"), rules).groupBy("blob", "rule").agg(F.array_sort(F.collect_set(F.struct("start", "k", "stop"))).alias("findings"))
    every = todo.select(F.col("_blob").alias("blob"), F.explode("todo").alias("rule"))
    return written(every.join(found, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("findings", F.array().cast("array<struct<start:bigint,k:int,stop:bigint>>")).alias("findings")), "ledger-new")


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of docs, and the ledger rows that were added.

    Findings: doc_id, blob, spans (array of start, k, stop in code points, by start, then rule). A null text is the empty
    text; a text without matches has an empty array. Rows that repeat a doc_id or a text, or both, each get their blob's
    findings.
    An empty table gives no rows and adds none.
    """
    versions = texts(docs).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    new = update_ledger(versions, ledger, rules)
    known = new if ledger is None else new.unionByName(ledger.select("blob", "rule", "findings"))
    wanted = known.filter(F.col("rule").isin([r.version for r in rules]) & (F.size("findings") > 0))
    spans = written(wanted.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("spans")).withColumnRenamed("blob", "_blob"), "ledger-spans")
    thin = versions.select("doc_id", "blob")
    return thin.join(spans, thin["blob"] == spans["_blob"], "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast("array<struct<start:bigint,k:int,stop:bigint>>")).alias("spans")), new


def find_secrets_stored(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every row of docs by the ledger stored at path (made if absent), to which what was scanned is added.

    A run over texts that the ledger has for all rule versions scans nothing. Findings are complete only once this returns.
    """
    spark = docs.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    findings, new = find_secrets(docs, spark.read.schema(LEDGER).parquet(path), rules)
    findings = written(findings, "ledger-findings")
    new.write.mode("append").parquet(path)
    return findings


def report(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans as text of each row of findings."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["start"], x["stop"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    return findings.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_split_to_array(t, {quoted(r.pattern)}) AS g, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS v FROM d"
        for k, r in enumerate(RULES)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({parts}),
b AS (SELECT doc_id, k, kind, least, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM a WHERE len(m) > 0),
c AS (SELECT doc_id, k, kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
      FROM b WHERE length(v[i]) >= least),
e AS (SELECT *, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM c),
f AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
      string_agg(span, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM e GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)
"""


ORACLE = _oracle()
