"""Shared helpers: written intermediate tables, thin document views, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest table (rows) that an operator broadcasts; every broadcast counts its rows first.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session's spark.checkpoint.dir; a new temporary one is set in local mode where none is (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark removes the shuffle files of a statement when it ends, and not when the driver's memory happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs no recomputation.

    Nothing reads the shuffles that made it again; their files are removed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/rillspark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and no other columns but those named."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if a count shows that it has at most so many rows, and whether it has."""
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if small else df), small


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with number, 0 for the first row by order; rows are dealt out by range, and each range starts at the rows before it."""
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted(ranged.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before = F.lit(0).cast("long")
    if sizes:
        starts, total = [], 0
        for r in sizes:
            starts += [F.lit(r["part"]), F.lit(total)]
            total += r["count"]
        before = F.create_map(*starts)[part]
    return ranged.withColumn("number", before + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")


def raw(column: pa.Array) -> list[bytes]:
    """A batch's strings as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000, width: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most size rows and, where rows hold bytes, of about width bytes."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or total >= width:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
