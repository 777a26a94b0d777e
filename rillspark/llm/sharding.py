"""Sharding by extendible hashing.

A row's 60 hash bits are the start of the MD5 of its key. A directory entry is a prefix of these bits; a bucket over the
byte limit splits on one more bit, and only such a bucket. As the result doesn't depend on the order of insertion, no
row is inserted one by one: one aggregate gives the bytes of all prefixes of a starting depth, their sums give the
shallower prefixes, and a bucket is the first prefix on a row's path that fits. Rows under a prefix that is still too
large at the starting depth, and they alone, go on to deeper bits. Only (key, bits, bytes) rows are shuffled, never texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written

BITS = 60
#: Bits that one round looks at beyond those already used; 2**STEP cells for each bucket that is still too large.
STEP = 8
#: The byte limit of a shard in the registered query.
SHARD_BYTES = 4 << 20


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as a long; a null key hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", bits, F.lit(BITS) - depth)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """depth, prefix, shard_rows, shard_bytes of every bucket, for rows with bits and n_bytes.

    A bucket at depth 60 whose rows share all bits (one key) can't split and stays over the limit.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done, pending, base = None, rows.select("bits", "n_bytes"), 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + 3))
    while True:
        cells = written(pending.groupBy(_prefix(F.col("bits"), depth).alias("cell")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")), "shard-cells")
        levels = (
            cells.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(depth))))
            .groupBy("depth", F.call_function("shiftright", F.col("cell"), (F.lit(depth) - F.col("depth")).cast("int")).alias("prefix"))
            .agg(F.sum("n").alias("shard_rows"), F.sum("b").alias("shard_bytes"))
        )
        levels = written(levels, "shard-levels")
        fits = levels.filter((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        parent = levels.filter(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        split = fits.withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1))).join(parent, ["depth", "parent"], "left_semi").drop("parent")
        buckets = split.unionByName(fits.filter("depth = 0")) if base == 0 else split
        done = buckets if done is None else done.unionByName(buckets)
        large = cells.filter(F.col("b") > limit).select(F.col("cell").alias("_cell"))
        if depth == BITS or large.isEmpty():
            return written(done.select("depth", "prefix", "shard_rows", "shard_bytes"), "shard-directory")
        pending = pending.join(large, _prefix(F.col("bits"), depth) == F.col("_cell"), "left_semi")
        base, depth = depth, min(BITS, depth + STEP)


def shard(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, depth, prefix, shard (its bits as text), shard_rows, shard_bytes.

    n_bytes are the UTF-8 bytes of text; null counts as empty. Rows with equal keys share all bits and so one shard; with
    unique keys only a single text above the limit leaves a shard above it. An empty table gives no rows. At least depth 0
    is always there, the whole table as one shard with the empty text as its name.
    """
    if limit < 1:
        raise ValueError("the limit must be at least one byte")
    rows = written(texts(docs, *[key] * (key != "doc_id")).select("doc_id", hash_bits(F.col(key)).alias("bits"), F.octet_length("text").cast("long").alias("n_bytes")), "shard-rows")
    leaves = directory(rows, limit)
    # a row meets its bucket at the bucket's own depth; buckets of one depth join as one equality
    depths = [r[0] for r in leaves.select("depth").distinct().orderBy("depth").collect()]
    at = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("bits"), d).alias("prefix")) for d in depths]) if depths else F.array().cast("array<struct<depth:int,prefix:bigint>>")
    found = rows.withColumn("e", F.explode(at)).select("doc_id", "n_bytes", "e.depth", "e.prefix")
    named = leaves.withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(F.expr(f"substring(lpad(bin(prefix), {BITS}, '0'), {BITS + 1} - depth, depth)")))
    return found.join(named, ["depth", "prefix"]).select("doc_id", "n_bytes", F.col("depth").cast("int"), "prefix", "shard", "shard_rows", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """docs as Parquet, one folder and one file per shard; a task writes whole shards."""
    placed = shard(docs, limit).select(F.col("doc_id").alias("_id"), F.col("shard"))
    joined = docs.join(placed, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    joined.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


ORACLE = f"""
WITH rows AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS bits, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
paths AS (SELECT *, d AS depth, bits >> ({BITS} - d) AS prefix FROM rows, range(0, {BITS + 1}) t(d)),
sums AS (SELECT depth, prefix, count(*) AS shard_rows, sum(n_bytes)::BIGINT AS shard_bytes FROM paths GROUP BY ALL),
first AS (SELECT p.doc_id, min(p.depth) AS depth FROM paths p JOIN sums s USING (depth, prefix) WHERE s.shard_bytes <= {SHARD_BYTES} OR p.depth = {BITS} GROUP BY 1)
SELECT p.doc_id, p.n_bytes, p.depth::INTEGER AS depth, p.prefix, s.shard_rows, s.shard_bytes,
       right(lpad(bin(p.prefix), {BITS}, '0'), p.depth::INTEGER) AS shard
FROM first f JOIN paths p USING (doc_id, depth) JOIN sums s USING (depth, prefix)
"""
