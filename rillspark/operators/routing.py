"""Dendritic routing of reach networks and of catchments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import UNRESOLVED, cut, hop_walk, shuffled


def unique_filler(df: DataFrame, column: str, key: str) -> DataFrame:
    """Nulls of an ordering column become values beyond its maximum, one each, in the order of key.

    Only the rows with nulls are numbered: dealt out in ranges of key, each range from the number of rows in those before.
    """
    top = df.agg(F.max(column)).first()[0] or 0
    ranged = cut(df.filter(F.col(column).isNull()).repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part, starts, total = F.shiftright("_at", 33), [F.lit(-1).cast("long"), F.lit(0).cast("long")], 0
    for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each range
        starts += [F.lit(r["part"]), F.lit(total).cast("long")]
        total += r["count"]
    start = F.create_map(*starts)[part]  # one literal, however many ranges there are
    number = F.lit(top) + start + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    filled = ranged.withColumn(column, number.cast(dict(df.dtypes)[column])).drop("_at")
    return df.filter(F.col(column).isNotNull()).unionByName(filled)


def merge_regions(flowlines: list[DataFrame], attributes: list[DataFrame], key: str = "comid") -> DataFrame:
    """Each region's flowlines with its attributes, all regions together; more rows than flowlines is an error."""
    out = None
    for lines, more in zip(flowlines, attributes, strict=True):
        joined = lines.join(more, key, "left")
        out = joined if out is None else out.unionByName(joined, allowMissingColumns=True)
    return out


def clip(lines: DataFrame, bounds: DataFrame, cell: float = 1.0) -> DataFrame:
    """Rows of lines (comid, minx, miny, maxx, maxy) whose envelope meets an envelope of bounds (minx to maxy), each once.

    Envelopes meet in the cells of a grid that both touch, so the join is an equality; cell should be about their size.
    """
    def cells(df: DataFrame) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
        return df.withColumn("_x", F.explode(span("minx", "maxx"))).withColumn("_y", F.explode(span("miny", "maxy")))

    a, b = cells(lines).alias("a"), cells(bounds.select("minx", "miny", "maxx", "maxy").distinct()).alias("b")
    meet = (F.col("a._x") == F.col("b._x")) & (F.col("a._y") == F.col("b._y"))
    for k in "xy":
        meet &= (F.col(f"a.min{k}") <= F.col(f"b.max{k}")) & (F.col(f"b.min{k}") <= F.col(f"a.max{k}"))
    return lines.join(a.join(b, meet, "left_semi").select("comid").distinct(), "comid", "left_semi")


def split_divergent(network: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Backbone candidates and divergent reaches (divergence 2)."""
    return network.filter("divergence <> 2 or divergence is null"), network.filter("divergence = 2")


def backbone(network: DataFrame) -> DataFrame:
    """comid, fromnode, tonode, tocomid: the best reach of each node, linked from node to node; no divergence.

    Best by stream calculator, then order, then low hydrologic sequence; ties go to the smallest comid.
    """
    priority = F.col("streamcalc") * 1000 + F.col("streamorde") * 100 - F.col("hydroseq") / 1e9
    kept = split_divergent(network)[0].withColumn("_p", priority)
    best = kept.groupBy("fromnode").agg(F.max_by(F.struct("comid", "tonode"), F.struct("_p", -F.col("comid"))).alias("b")).select("b.comid", "fromnode", "b.tonode")
    return best.join(node_map(best), "tonode", "left").select("comid", "fromnode", "tonode", F.col("target").alias("tocomid"))


def node_map(network: DataFrame) -> DataFrame:
    """tonode, target: the reach that starts at a node; of several the first in hydrologic order, then by comid."""
    first = F.struct("hydroseq", "comid") if "hydroseq" in network.columns else F.col("comid")
    return network.groupBy(F.col("fromnode").alias("tonode")).agg(F.min_by("comid", first).alias("target"))


def patched(routing: DataFrame, network: DataFrame) -> DataFrame:
    """comid, tocomid: null targets replaced by the reach that starts where the reach ends, if there is one."""
    full = routing.join(network.select("comid", "tonode"), "comid", "left").join(node_map(network), "tonode", "left")
    return full.select("comid", F.coalesce("tocomid", "target").alias("tocomid"))


def divergent_targets(network: DataFrame, main: DataFrame, max_hops: int = 20) -> DataFrame:
    """comid, tocomid of divergent reaches: the backbone reach that starts at their end, else the first backbone reach
    on the way down the original network, within max_hops; else null."""
    aside = split_divergent(network)[1].join(main.select("comid"), "comid", "left_anti")
    direct = aside.join(node_map(main), "tonode", "left").select("comid", F.col("target").alias("_direct"))
    walked = hop_walk(direct.filter("_direct is null").select(F.col("comid").alias("id")), network, main.select(F.col("comid").alias("id")), max_hops, None)
    return direct.join(walked.select(F.col("id").alias("comid"), "target"), "comid", "left").select("comid", F.coalesce("_direct", "target").alias("tocomid"))


def dendritic(network: DataFrame) -> DataFrame:
    """comid, tocomid, divergent, terminal: the backbone with divergent reaches put back, one target each."""
    main = backbone(network)
    both = main.select("comid", "tocomid", F.lit(False).alias("divergent")).unionByName(divergent_targets(network, main).withColumn("divergent", F.lit(True)))
    return both.withColumn("terminal", F.col("tocomid").isNull())


def route_catchments(catchments: DataFrame, network: DataFrame, terminal: DataFrame, adjacency: DataFrame | None = None, max_hops: int = 15) -> DataFrame:
    """featureid, target, hops, status of every catchment.

    Catchments (featureid) are routed to the first reach downstream that has a catchment; those of terminal reaches, or of
    reaches without target, have target 0. The rest takes the target of the neighbour (a, b, shared_len) with the longest
    shared boundary that has one (the smallest id of several); -1 without any. Status: routed, terminal, resolved,
    no_candidates, no_shared_boundary, unresolved. Catchments that aren't in the network have null hops.
    """
    ids = catchments.select(F.col("featureid").alias("id"))
    reach = network.select(F.col("comid").alias("id"), "tocomid", F.lit(True).alias("known"))
    ends = terminal.select(F.col("comid").alias("id")).distinct().withColumn("end", F.lit(True))
    base = ids.join(shuffled(reach), "id", "left").join(shuffled(ends), "id", "left").join(shuffled(hop_walk(ids, network, ids, max_hops, None)), "id")
    ended = F.coalesce("end", F.lit(False))
    no_target = F.col("known") & F.col("tocomid").isNull()
    status = F.when(ended | F.coalesce(no_target, F.lit(False)), "terminal").when(F.col("target").isNotNull(), "routed").when(F.col("known"), "unresolved")
    base = base.select(
        F.col("id").alias("featureid"), F.when(status == "terminal", F.lit(0)).otherwise(F.coalesce("target", F.lit(UNRESOLVED))).cast("long").alias("target"),
        F.when(ended, -1).when(status == "terminal", 0).when(F.col("known"), F.col("hops")).alias("hops"), status.alias("status"),
    )
    if adjacency is None:
        return base.withColumn("status", F.coalesce("status", F.lit("unresolved")))
    both = adjacency.unionByName(adjacency.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared_len"))
    donors = base.filter("status in ('routed', 'terminal')").select(F.col("featureid").alias("b"), F.col("target").alias("given"))
    near = both.join(shuffled(donors), "b").groupBy(F.col("a").alias("featureid")).agg(F.max("shared_len").alias("longest"), F.max_by("given", F.struct("shared_len", -F.col("b"))).alias("given"))
    out = base.join(shuffled(near), "featureid", "left")
    orphan = F.col("status").isNull()
    return out.select(
        "featureid", F.when(orphan & (F.col("longest") > 0), F.col("given")).otherwise(F.col("target")).alias("target"), "hops",
        F.coalesce("status", F.when(F.col("longest").isNull(), "no_candidates").when(F.col("longest") <= 0, "no_shared_boundary").otherwise("resolved")).alias("status"),
    )


def summary(routed: DataFrame) -> DataFrame:
    """status, hops, n."""
    return routed.groupBy("status", "hops").agg(F.count("*").alias("n"))


def high_resolution(flowlines: DataFrame, flow: DataFrame) -> DataFrame:
    """nhdplusid, tonhdplusid, source: the largest target of each flowline in the network; one off the table is null.

    Divergent flowlines, which the backbone leaves out, are added with the target that the flow table gives them.
    """
    local = flow.join(flowlines.select(F.col("nhdplusid").alias("fromnhdpid")), "fromnhdpid", "left_semi")
    best = local.groupBy(F.col("fromnhdpid").alias("nhdplusid")).agg(F.max("tonhdpid").alias("to"))
    inside = flowlines.select(F.col("nhdplusid").alias("in"))
    linked = lambda df: df.join(best, "nhdplusid", "left").join(inside, F.col("to") == F.col("in"), "left").select("nhdplusid", F.col("in").alias("tonhdplusid"))
    main = flowlines.filter("innetwork = 1 and divergence <> 2").select("nhdplusid")
    orphans = flowlines.select("nhdplusid").join(main, "nhdplusid", "left_anti")
    return linked(main).withColumn("source", F.lit("backbone")).unionByName(linked(orphans).withColumn("source", F.lit("orphan")))
