"""Walks and closures on reach graphs, as joins over all starts at once.

Every round is one equality join; finished walks leave the loop. Intermediate tables are written to the folder in
spark.checkpoint.dir where the session names one, else checkpointed to a temporary one, so plans stay short and lost
executors cost one round.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNRESOLVED = -1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a new temporary one in local mode, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="rillspark-")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage ended by a checkpoint."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Spark removes the shuffle files of a statement when it ends, and not when the driver's memory happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and not again when an executor is lost.

    Nothing reads the shuffles that made it again; their files are removed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Takes away the files of a table made by stored() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join in which both sides grow with the input: the planner takes a cut table, or one with exploded rows, for as
    small as the compressed file that it comes from, and would broadcast it through the driver."""
    return df.hint("merge")


def hop_walk(starts: DataFrame, edges: DataFrame, valid: DataFrame, max_hops: int = 15, unresolved: int | None = UNRESOLVED) -> DataFrame:
    """id, target, hops: from each id along tocomid to the first id in valid, hops 0 to max_hops - 1.

    starts: id. edges: comid, tocomid (one per comid). valid: id, without repeats. hops counts the steps after the direct
    target, so 0 says that this was valid. A walk that isn't resolved tells in hops where it left the graph (-1: it has no
    direct target), or max_hops if it is too long or runs in a circle. Jumps double: about log2(max_hops) joins of the graph with
    itself, and as many of the starts with it.
    """
    ways = edges.select("comid", "tocomid")
    nodes = ways.unionByName(ways.select(F.col("tocomid").alias("comid")).filter("comid is not null").distinct().join(shuffled(ways.select("comid")), "comid", "left_anti").withColumn("tocomid", F.lit(None).cast("long")))
    # of the 2**k ids from comid on: the first valid one and its place, or the place where the walk left the graph, or the id after them
    isin = F.col("_valid").isNotNull()
    look = nodes.join(shuffled(valid.select(F.col("id").alias("_valid"))), F.col("comid") == F.col("_valid"), "left").select(
        F.col("comid").alias("_c"), F.col("_valid").alias("_t"), F.when(isin, 0).when(F.col("tocomid").isNull(), 1).alias("_n"), F.when(~isin, F.col("tocomid")).alias("_a"))
    walk = starts.select("id").join(shuffled(ways.toDF("_from", "_to")), F.col("id") == F.col("_from"), "left")
    walk = walk.select("id", F.col("_to").alias("at"), F.lit(None).cast("long").alias("target"), F.when(F.col("_to").isNull(), -1).alias("hops"), F.lit(0).alias("seen"))
    for k in range(max_hops.bit_length()):
        look = stored(look, "hops")
        if max_hops >> k & 1:
            onward = walk.join(shuffled(look), F.col("at") == F.col("_c"), "left")
            walk = stored(onward.select("id", F.col("_a").alias("at"), F.coalesce("target", "_t").alias("target"), F.coalesce("hops", F.col("seen") + F.col("_n")).alias("hops"), (F.col("seen") + (1 << k)).alias("seen")), "hops")
        if k + 1 < max_hops.bit_length():
            after = look.select(F.col("_c").alias("_d"), F.col("_t").alias("_t2"), F.col("_n").alias("_n2"), F.col("_a").alias("_a2"))
            look = look.join(shuffled(after), F.col("_a") == F.col("_d"), "left").select("_c", F.coalesce("_t", "_t2").alias("_t"), F.coalesce("_n", F.col("_n2") + (1 << k)).alias("_n"), F.col("_a2").alias("_a"))
    target = F.coalesce("target", F.lit(unresolved).cast("long")).alias("target")
    return walk.select("id", target, F.coalesce("hops", F.lit(max_hops)).alias("hops"))


#: Rows that jumps between forks may grow to, as a multiple of what they started with, before walks go step by step.
GROWTH = 16


def upstream(edges: DataFrame, targets: DataFrame, include_self: bool = False) -> DataFrame:
    """target, up: every id from which target is reached, each once, circles included; target itself if asked for.

    edges: comid, tocomid. targets: id. Each id's least way down makes a forest, once every circle is cut behind its least
    id; ways that are left over are few where networks are rivers. In the forest jumps double: about log2 of the longest
    chain in rounds. Only targets and the ends of ways left over are then walked between, doubling again.
    """
    edges = stored(edges.select("comid", "tocomid").filter("comid is not null and tocomid is not null").distinct(), "edges")
    targets = stored(targets.select("id").distinct(), "targets")
    nodes = edges.select("comid").union(edges.select("tocomid")).union(targets.select("id")).distinct()
    ways = stored(nodes.join(edges.groupBy("comid").agg(F.min("tocomid").alias("tocomid")), "comid", "left"), "ways")
    cuts = circle_ends(ways)
    circles, forks = not cuts.isEmpty(), edges.count() > ways.filter("tocomid is not null").count()
    trees, goals, extra = ways, targets, None
    if circles:
        trees = stored(ways.join(cuts.select(F.col("comid").alias("_c")), F.col("comid") == F.col("_c"), "left").select("comid", F.when(F.col("_c").isNull(), F.col("tocomid")).alias("tocomid")), "trees")
    if circles or forks:
        extra = stored(edges.join(trees, ["comid", "tocomid"], "left_anti").select("comid", "tocomid"), "extra")
        goals = stored(targets.select("id").union(extra.select("comid")).union(extra.select("tocomid")).distinct(), "goals")
    reach = _nearest_goals(trees, goals)
    below = reach.select(F.col("comid").alias("_c"), F.col("near").alias("to"))
    down = trees.join(goals, F.col("comid") == F.col("id")).join(below, F.col("tocomid") == F.col("_c")).select(F.col("comid").alias("from"), "to")
    if extra is not None:
        down = down.union(extra.toDF("from", "to")).distinct()
    inner = _closure(down, targets, forest=extra is None)
    pairs = reach.join(inner.select(F.col("up").alias("_up"), "target"), F.col("near") == F.col("_up")).select("target", F.col("comid").alias("up"))
    return pairs if include_self else pairs.filter("target <> up")


def circle_ends(ways: DataFrame) -> DataFrame:
    """comid, tocomid: of every circle of ways (comid, tocomid; one way down each) the least id and its way."""
    circling = stored(depth_to_outlet(ways).filter("depth is null").select("comid"), "circling")
    n = circling.count()
    if not n:
        return circling.select("comid", F.lit(None).cast("long").alias("tocomid"))
    state = ways.join(circling, "comid", "left_semi").select("comid", F.col("tocomid").alias("at"), F.col("comid").alias("low"))
    for _ in range(n.bit_length()):  # at is so many steps on, low the least id on the way there
        state = stored(state, "circling")
        over = state.select(F.col("comid").alias("_c"), F.col("at").alias("_a"), F.col("low").alias("_l"))
        state = state.join(over, F.col("at") == F.col("_c")).select("comid", F.col("_a").alias("at"), F.least("low", "_l").alias("low"))
    state = stored(state, "circling")
    on = state.select(F.col("at").alias("_on")).distinct()  # after as many steps as there are ids all are on circles
    least = state.filter("comid = low").join(on, F.col("comid") == F.col("_on"), "left_semi").select("comid")
    return ways.join(least, "comid", "left_semi")


def _nearest_goals(trees: DataFrame, goals: DataFrame) -> DataFrame:
    """comid, near: the first goal (id) at or below each id of a forest; ids without one are left out."""
    goal = goals.select(F.col("id").alias("_goal"))
    reach = trees.join(goal, F.col("comid") == F.col("_goal"), "left").select("comid", F.col("_goal").alias("near"), F.when(F.col("_goal").isNull(), F.col("tocomid")).alias("at"))
    while True:
        reach = stored(reach, "reach")
        if reach.filter("at is not null").isEmpty():
            return reach.filter("near is not null").select("comid", "near")
        over = reach.select(F.col("comid").alias("_c"), F.col("near").alias("_n"), F.col("at").alias("_a"))
        reach = reach.join(over, F.col("at") == F.col("_c"), "left").select("comid", F.coalesce("near", "_n").alias("near"), F.col("_a").alias("at"))


def _closure(edges: DataFrame, targets: DataFrame, forest: bool) -> DataFrame:
    """up, target: every id from which a target (id) is reached along edges (from, to), targets themselves included.

    What is known after k rounds are the walks of fewer than 2**k steps, jump has those of 2**k; when a round finds no new pair
    none is left. Where many ways fork, jumps grow; walks then go on a step at a time from the pairs found last. In a forest
    each pair has one walk, so none is found twice.
    """
    spark = edges.sparkSession
    jump = edges = stored(edges, "jump")
    most, folder, shape = GROWTH * (edges.count() + 1000), f"{shared_folder(spark)}/closure-{uuid.uuid4().hex}", "up long, target long"
    all_ = lambda: spark.read.schema(shape).option("recursiveFileLookup", True).parquet(folder)
    new, rounds, squaring = targets.select(F.col("id").alias("up"), F.col("id").alias("target")), 0, True
    while True:
        new.write.parquet(f"{folder}/{rounds}")
        new = spark.read.schema(shape).parquet(f"{folder}/{rounds}")
        if new.isEmpty() or jump.isEmpty():
            return all_()
        by, start = (jump, all_()) if squaring else (edges, new)
        step = by.join(start.select(F.col("up").alias("_up"), "target"), F.col("to") == F.col("_up")).select(F.col("from").alias("up"), "target")
        if squaring:
            over = jump.select(F.col("from").alias("_mid"), F.col("to").alias("_to"))
            more = jump.join(over, F.col("to") == F.col("_mid")).select("from", F.col("_to").alias("to"))
            jump = stored(more if forest else more.distinct(), "jump")
            if jump.count() > most:
                squaring, step = False, edges.join(all_().select(F.col("up").alias("_up"), "target"), F.col("to") == F.col("_up")).select(F.col("from").alias("up"), "target")
        new = step if forest else step.distinct().join(all_(), ["up", "target"], "left_anti")
        rounds += 1


def depth_to_outlet(edges: DataFrame) -> DataFrame:
    """comid, outlet, depth for a forest, by pointer doubling: a chain of n reaches takes about log2(n) rounds.

    Reaches on or above a circle have null outlet and depth.
    """
    known = edges.select(F.col("comid").alias("_c"))
    state = edges.join(known, F.col("tocomid") == F.col("_c"), "left").select("comid", F.coalesce("_c", "comid").alias("at"), F.col("_c").isNotNull().cast("long").alias("depth"))
    n = edges.count()
    for _ in range(math.ceil(math.log2(max(2, n))) + 1):
        state = stored(state, "depth")
        over = state.select(F.col("comid").alias("_c"), F.col("at").alias("_at"), F.col("depth").alias("_d"))
        moved = state.join(over, F.col("at") == F.col("_c"))
        if moved.filter("_d > 0").isEmpty():
            return state.select("comid", F.col("at").alias("outlet"), "depth")
        state = moved.select("comid", F.col("_at").alias("at"), (F.col("depth") + F.col("_d")).alias("depth"))
    state = stored(state, "depth")
    ends = state.filter("depth = 0").select(F.col("comid").alias("_end"))
    ok = F.col("_end").isNotNull()
    return state.join(ends, F.col("at") == F.col("_end"), "left").select("comid", F.when(ok, F.col("at")).alias("outlet"), F.when(ok, F.col("depth")).alias("depth"))


def basins(edges: DataFrame) -> DataFrame:
    """comid, basin: for every id the ids above it, sorted, itself first."""
    all_ = upstream(edges, edges.select(F.col("comid").alias("id")), include_self=True)
    sorted_ = F.array_sort(F.collect_list(F.struct((F.col("target") != F.col("up")).alias("o"), "up")))
    return all_.groupBy(F.col("target").alias("comid")).agg(F.transform(sorted_, lambda x: x["up"]).alias("basin"))


def route(comid: int, catchments: DataFrame, hucs: DataFrame) -> DataFrame:
    """kind (catchment or huc12), id: what lies above a catchment.

    For one on the mainstem, the catchments above it in its own HUC and the HUCs above that; else all catchments above it.
    An unknown catchment is an error.
    """
    row = catchments.filter(F.col("comid") == comid).first()
    if row is None:
        raise ValueError(f"no catchment {comid}")
    spark = catchments.sparkSession
    one = lambda x: spark.range(x, x + 1).select("id")
    up = upstream(catchments, one(comid)).select(F.col("up").alias("comid"))
    if row["ismainstem"] != 1:
        return up.select(F.lit("catchment").alias("kind"), F.col("comid").alias("id"))
    local = up.join(catchments.filter(F.col("huc12") == row["huc12"]).select("comid"), "comid", "left_semi")
    above = upstream(hucs.select(F.col("huc12").alias("comid"), F.col("tohuc").alias("tocomid")), one(row["huc12"]))
    return local.select(F.lit("catchment").alias("kind"), F.col("comid").alias("id")).unionByName(above.select(F.lit("huc12").alias("kind"), F.col("up").alias("id")))


def route_catchments(comid: int, catchments: DataFrame, hucs: DataFrame) -> DataFrame:
    """comid of all catchments of route()'s HUCs, and of its own catchments, each once."""
    found = route(comid, catchments, hucs)
    in_hucs = catchments.join(found.filter("kind = 'huc12'").select(F.col("id").alias("huc12")), "huc12", "left_semi").select("comid")
    return in_hucs.union(found.filter("kind = 'catchment'").select("id")).distinct()


def export_route(found: DataFrame, catchments: DataFrame, hucs: DataFrame, path: str) -> list[str]:
    """Writes what route() found with its geometries, one table for catchments and one for HUCs; the folders written.

    Tables without a geometry column are an error. A kind with no rows has no folder.
    """
    written = []
    for kind, table, key in (("catchment", catchments, "comid"), ("huc12", hucs, "huc12")):
        if "geometry" not in table.columns:
            raise ValueError(f"no geometry to export: {kind}")
        part = table.join(found.filter(F.col("kind") == kind).select(F.col("id").alias(key)), key, "left_semi")
        if not part.isEmpty():
            part.write.mode("overwrite").parquet(f"{path}/{kind}")
            written.append(f"{path}/{kind}")
    return written
