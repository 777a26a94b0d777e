"""Basin attributes: zonal statistics, area weights, mainstems, propagation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio, require_columns

MEDIANS = ("slope", "elevation")


def shape(area_m2: Column, perimeter_m: Column) -> list[Column]:
    """Area in square kilometres, perimeter in kilometres, compactness (null without a perimeter)."""
    compact = ratio(4 * math.pi * area_m2, F.nullif(perimeter_m * perimeter_m, F.lit(0.0)))
    return [(area_m2 / 1e6).alias("area_km2"), (perimeter_m / 1e3).alias("perimeter_km"), compact.alias("compactness")]


def zonal(pixels: DataFrame, statistic: str = "mean") -> DataFrame:
    """zone, value, n by mean or median; rasters named in MEDIANS take the median."""
    f = F.median if statistic == "median" or statistic in MEDIANS else F.avg
    return pixels.groupBy("zone").agg(f("value").alias("value"), F.count("value").alias("n"))


def area_weighted(overlay: DataFrame, *values: str) -> DataFrame:
    """zone and, for each value column, its mean weighted by area; a missing value's area doesn't count for its column."""
    return overlay.groupBy("zone").agg(*[ratio(F.sum(F.col(v) * F.col("area")), F.sum(F.when(F.col(v).isNotNull(), F.col("area")))).alias(v) for v in values])


def mainstem(reaches: DataFrame) -> DataFrame:
    """Adds ismainstem: 1 for reaches of the commonest level path among those of the highest order in their HUC.

    Of several commonest paths the smallest counts.
    """
    require_columns(reaches, "huc12", "streamorde", "levelpathi")
    top = reaches.withColumn("_o", F.max("streamorde").over(Window.partitionBy("huc12"))).filter("streamorde = _o")
    main = top.groupBy("huc12", "levelpathi").agg(F.count("*").alias("n")).groupBy("huc12").agg(F.max_by("levelpathi", F.struct("n", -F.col("levelpathi"))).alias("_main"))
    return reaches.join(main, "huc12", "left").withColumn("ismainstem", F.coalesce(F.col("levelpathi") == F.col("_main"), F.lit(False)).cast("int")).drop("_main")


def transferred(rows: DataFrame, values: DataFrame, key: str, column: str, order: str | None = None) -> DataFrame:
    """rows with column from values where it has the key, the old value else; updated tells which.

    Of several values of a key the one that is first by order counts, without order the smallest.
    """
    known = values.filter(F.col(column).isNotNull())
    first = known.groupBy(key).agg(F.min_by(column, F.struct(order or column, column)).alias("_new"))
    return rows.join(first, key, "left").withColumn("updated", F.col("_new").isNotNull()).withColumn(column, F.coalesce("_new", column)).drop("_new")


def local_for_tributaries(rows: DataFrame, local: DataFrame, column: str) -> DataFrame:
    """Rows off the mainstem take their HUC's local value; an unmatched HUC keeps the old one."""
    joined = rows.join(local.select("huc12", F.col(column).alias("_local")), "huc12", "left")
    return joined.withColumn(column, F.when((F.col("ismainstem") != 1) & F.col("_local").isNotNull(), F.col("_local")).otherwise(F.col(column))).drop("_local")


def keys_diagnosis(a: DataFrame, b: DataFrame, key: str, width: int = 12) -> DataFrame:
    """key, side: keys of only one table, also after padding digits with zeros on the left."""
    padded = F.when(F.col(key).rlike(f"^[0-9]{{1,{width - 1}}}$"), F.lpad(key, width, "0")).otherwise(F.col(key))
    left, right = (df.select(padded.alias("key")).distinct() for df in (a, b))
    return left.join(right, "key", "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, "key", "left_anti").withColumn("side", F.lit("right")))


def zonal_update(rows: DataFrame, stats: DataFrame, column: str, subset: list | None = None) -> DataFrame:
    """rows (zone, column) with the zones' statistics; with a subset only its zones change, and keep a value that has no new one."""
    joined = rows.join(stats.select("zone", F.col("value").alias("_new")), "zone", "left")
    value = F.col("_new") if subset is None else F.when(F.col("zone").isin(subset), F.coalesce("_new", column)).otherwise(F.col(column))
    return joined.withColumn(column, value).drop("_new")


def fields_to_add(table: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted names that the table lacks, whatever their case."""
    have = {c.lower() for c in table.columns}
    return [w for w in wanted if w.lower() not in have]


def field_name(text: str) -> str:
    """A name of letters, digits and underscores that starts with a letter."""
    name = "".join(c if c.isalnum() else "_" for c in text)
    return name if name[:1].isalpha() else f"f_{name}"


#: Names under which tools give the zone back (fixed values), and the types that a zone may have.
ZONE_NAMES, ZONE_TYPES = ("ZONE", "VALUE", "ZONE_CODE"), ("string", "int", "smallint", "bigint", "tinyint")


def zone_field(table: DataFrame, candidate: str) -> str:
    """The column that holds a zonal table's zones: the candidate whatever its case, else a usual name, else the first column of
    text or whole numbers. A table without one is an error."""
    for name in table.columns:
        if name.upper() == candidate.upper():
            return name
    for name in ZONE_NAMES:
        if name in table.columns:
            return name
    for name, kind in table.dtypes:
        if kind in ZONE_TYPES:
            return name
    raise RuntimeError(f"no usable zone field: {', '.join(table.columns)}")


def pushed(master: DataFrame, up: DataFrame, local: DataFrame, column: str) -> DataFrame:
    """comid, huc12, old, new of rows whose value changes: mainstems from up by comid, the rest from local by huc12."""
    joined = master.join(up.select("comid", F.col(column).alias("_up")), "comid", "left").join(local.select("huc12", F.col(column).alias("_local")), "huc12", "left")
    new = F.when(F.col("ismainstem") == 1, F.col("_up")).otherwise(F.col("_local"))
    return joined.select("comid", "huc12", F.col(column).alias("old"), new.alias("new")).filter(~F.col("old").eqNullSafe(F.col("new")))


def dry_run(changes: DataFrame) -> DataFrame:
    """huc12, n: the changes that pushed() would write."""
    return changes.groupBy("huc12").agg(F.count("*").alias("n"))


def discovered(tables: dict[str, DataFrame], needed: dict[str, list[str]]) -> DataFrame:
    """source, field, n: how many values each needed field has. A table or a field that isn't there is an error, all named."""
    missing = [t for t in needed if t not in tables] + [f"{t}.{f}" for t, fields in needed.items() if t in tables for f in fields if f.lower() not in map(str.lower, tables[t].columns)]
    if missing:
        raise RuntimeError(f"missing: {', '.join(missing)}")
    out = None
    for t, fields in needed.items():
        counts = tables[t].agg(*[F.count(f).alias(f"n{i}") for i, f in enumerate(fields)])
        rows = counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("source"), F.lit(f).alias("field"), F.col(f"n{i}").alias("n")) for i, f in enumerate(fields)])).alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def field_names(column: Column) -> Column:
    """field_name() of a column of texts, for letters and digits of ASCII."""
    name = F.regexp_replace(column, "[^A-Za-z0-9]", "_")
    return F.when(name.rlike("^[A-Za-z]"), name).otherwise(F.concat(F.lit("f_"), name))


def same_geometry(zones: DataFrame, sources: DataFrame) -> bool:
    """Whether two tables of geometries count as the same: as many rows, of the same types (kind) and reference systems (crs)."""
    told = [df.groupBy("kind", "crs").count().orderBy("kind", "crs").collect() for df in (zones, sources)]
    return told[0] == told[1]


def direct_transfer(zones: DataFrame, sources: DataFrame, key: str, column: str) -> DataFrame | None:
    """zones with column of sources by key where both count as the same geometry; None where an overlay is needed."""
    if not same_geometry(zones, sources):
        return None
    return zones.drop(column).join(sources.select(key, column), key, "left")
