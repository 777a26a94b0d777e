"""Readers and writers: one long table for a folder of per-site files, lookups, geometry as bytes."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import stored


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header and a given schema; nothing is inferred, so the files are read once."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def file_stem(prefix: str = "") -> Column:
    """The name of a row's file without folder, suffix and prefix; readers of a folder use it as the site."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[A-Za-z]+)*$", 1)
    return F.regexp_replace(name, f"^{prefix}", "") if prefix else name


def read_sites(spark: SparkSession, folder: str, value: str = "q", sep: str = ",", prefix: str = "") -> DataFrame:
    """site, d, q of a folder of files, one per site, whose first column is a date; bad dates go, bad numbers are null."""
    df = spark.read.option("header", True).option("sep", sep).csv(folder)
    names = df.columns
    if value not in names:
        raise ValueError(f"no column {value}")
    day = F.to_date(F.try_to_timestamp(F.col(f"`{names[0]}`")))
    return df.select(file_stem(prefix).alias("site"), day.alias("d"), F.col(f"`{value}`").try_cast("double").alias("q")).filter("d is not null")


#: Names of a workbook's parts (fixed values of the format).
SHEET, STRINGS, MAIN = "xl/worksheets/sheet1.xml", "xl/sharedStrings.xml", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet(data: bytes) -> list[list[tuple[str | None, bool]]]:
    """Rows of a workbook's first sheet: each cell's text and whether it is a number; cells left out are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
        shared = [text(s) for s in ElementTree.fromstring(book.read(STRINGS)).iter(f"{MAIN}si")] if STRINGS in book.namelist() else []
        rows = []
        for row in ElementTree.fromstring(book.read(SHEET)).iter(f"{MAIN}row"):
            cells: list[tuple[str | None, bool]] = []
            for cell in row.iter(f"{MAIN}c"):
                at = 0
                for c in re.match("[A-Z]*", cell.get("r", "")).group():
                    at = at * 26 + ord(c) - 64
                cells += [(None, False)] * (at - 1 - len(cells))
                kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
                if kind == "inlineStr":
                    cells.append((text(cell), False))
                elif value is None or value.text is None:
                    cells.append((None, False))
                else:
                    cells.append((shared[int(value.text)] if kind == "s" else value.text, kind == "n"))
            rows.append(cells)
    return rows


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of a workbook, or of all in a folder, by the names in their first rows.

    Each workbook is read by a task. A column in which all values are numbers is double, any other is text; one that some
    workbooks lack is null there. Rows without values are left out.
    """

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                names, *rows = _sheet(data) or [[]]
                out = [(file, i, k, names[k][0], text, number) for i, row in enumerate(rows) for k, (text, number) in enumerate(row) if text is not None and k < len(names) and names[k][0]]
                yield pd.DataFrame(out, columns=["file", "row", "at", "name", "text", "number"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    flat = stored(found.mapInPandas(cells, "file string, row long, at long, name string, text string, number boolean"), "workbook")
    columns = flat.groupBy("name").agg(F.min("at").alias("at"), F.every("number").alias("number")).orderBy("at", "name").collect()  # a row for each column
    value = lambda c: F.max(F.when(F.col("name") == c["name"], F.col("text"))).cast("double" if c["number"] else "string").alias(c["name"])
    return flat.groupBy("file", "row").agg(*[value(c) for c in columns]).drop("file", "row") if columns else spark.createDataFrame([], "empty string")


def write_workbooks(df: DataFrame, path: str, by: str) -> DataFrame:
    """A workbook for each value of a column, in a local or shared folder that tasks can write to; the paths written.

    A value's rows are one sheet, written by one task; a sheet holds about a million rows at most.
    """
    names = df.columns
    letters = lambda k: (letters(k // 26 - 1) if k > 25 else "") + chr(65 + k % 26)

    def cell(at: str, v: object) -> str:
        if v is None or v != v:
            return ""
        return f'<c r="{at}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    def write(part: pd.DataFrame) -> pd.DataFrame:
        rows = [names, *part[names].astype(object).to_numpy().tolist()]
        sheet = "".join(f'<row r="{i}">' + "".join(cell(f"{letters(k)}{i}", v) for k, v in enumerate(row)) + "</row>" for i, row in enumerate(rows, 1))
        space, made = MAIN[1:-1], io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as book:
            for name, body in _BOOK.items():
                book.writestr(name, body)
            book.writestr(SHEET, f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{space}"><sheetData>{sheet}</sheetData></worksheet>')
        file = f"{path.removeprefix('file://')}/{part[by].iloc[0]}.xlsx"
        os.makedirs(os.path.dirname(file), exist_ok=True)
        with open(file, "wb") as out:
            out.write(made.getvalue())
        return pd.DataFrame({"path": [file]})

    return df.groupBy(by).applyInPandas(write, "path string")


#: The parts of a workbook with one sheet (fixed values of the format).
_BOOK = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, Excel workbooks or Parquet by suffix; other suffixes are an error."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if path.endswith(".xlsx"):
        return read_workbooks(spark, path)
    if path.endswith(".xls"):  # the older binary format: read on the driver, where pandas finds a library for it
        return spark.createDataFrame(pd.read_excel(path))
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def stems(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """name of every file in a folder, without suffix and prefix."""
    return spark.read.option("header", True).csv(folder).select(file_stem(prefix).alias("name")).distinct()


def copy_listed(df: DataFrame, sites: Iterable[str], path: str) -> None:
    """The listed sites' rows, one folder per site."""
    df.filter(F.col("site").isin(*sites)).repartition("site").write.mode("overwrite").partitionBy("site").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_columns(df: DataFrame, path: str, *columns: str) -> None:
    """A subset of columns as Parquet, those that the table has."""
    df.select(*[c for c in columns if c in df.columns]).write.mode("overwrite").parquet(path)


def write_sites(stats: DataFrame, path: str) -> DataFrame:
    """Statistics as one folder per site; the whole-record rows of all sites, site first, are returned."""
    stats.repartition("site").write.mode("overwrite").partitionBy("site").parquet(path)
    rest = [c for c in stats.columns if c not in ("site", "scope")]
    return stats.filter("scope = 'all_years'").select(F.col("site").alias("site_name"), *rest)


#: Geometry types of well-known binary.
LINE, POLYGON, MULTI_LINE = 2, 3, 5


def _code(wkb: Column) -> Column:
    """The type's four bytes in hex, high byte first, whatever the byte order."""
    h = F.hex(F.substring(wkb, 2, 4))
    return F.when(F.hex(F.substring(wkb, 1, 1)) == "00", h).otherwise(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def geometry_type(wkb: Column) -> Column:
    """The type of well-known binary of either byte order, without what it tells about dimensions; null for null and empty bytes."""
    code = F.conv(F.nullif(_code(wkb), F.lit("")), 16, 10).cast("long")
    return (code.bitwiseAND(0x0FFFFFFF) % 1000).cast("int")


def promoted(wkb: Column) -> Column:
    """A line as a multi-line of one, in its own byte order and dimensions; other geometries as they are."""
    little = F.hex(F.substring(wkb, 1, 1)) == "01"
    code = F.lpad(F.hex(F.conv(_code(wkb), 16, 10).cast("long").bitwiseAND(0xDFFFFFFF) + 3), 8, "0")  # the reference system stays with the line
    turned = F.concat(*[F.substring(code, i, 2) for i in (7, 5, 3, 1)])
    head = F.when(little, F.concat(F.lit("01"), turned, F.lit("01000000"))).otherwise(F.concat(F.lit("00"), code, F.lit("00000001")))
    return F.when(geometry_type(wkb) == LINE, F.concat(F.unhex(head), wkb)).otherwise(wkb)
