"""Workbooks and fields that hold zones."""

import zipfile

import pytest

from rillspark import sources
from rillspark.operators import basin


def test_workbooks_are_written_and_read_back(spark, tmp_path):
    rows = [(1, "a<b & c", 2.5, None), (1, " pad ", None, "x"), (2, None, -1.0, "y")]
    table = spark.createDataFrame(rows, "k long, name string, v double, note string")
    files = [r["path"] for r in sources.write_workbooks(table, str(tmp_path / "books"), "k").collect()]
    assert len(files) == 2 and all(zipfile.is_zipfile(f) for f in files)
    got = sources.read_workbooks(spark, str(tmp_path / "books"))
    assert got.dtypes == [("k", "double"), ("name", "string"), ("v", "double"), ("note", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=lambda r: str((float(r[0]), *r[1:])))
    assert sources.read_table(spark, sorted(files)[1]).collect() == [(2.0, -1.0, "y")]
    with pytest.raises(ValueError, match="unsupported file type"):
        sources.read_table(spark, "x.shp")


def test_workbooks_with_shared_texts_and_left_out_cells(spark, tmp_path):
    space = sources.MAIN[1:-1]
    sheet = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2"><v>99</v></c><c r="C2" t="s"><v>2</v></c></row><row r="3"><c r="C3"/></row><row r="4"><c r="C4"><v>3</v></c></row>'
    with zipfile.ZipFile(tmp_path / "one.xlsx", "w") as book:
        book.writestr(sources.STRINGS, f'<sst xmlns="{space}"><si><t>n</t></si><si><t>te</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        book.writestr(sources.SHEET, f'<worksheet xmlns="{space}"><sheetData>{sheet}</sheetData></worksheet>')
    got = sources.read_workbooks(spark, str(tmp_path))
    assert got.dtypes == [("n", "double"), ("te", "string")] and sorted(map(tuple, got.collect()), key=str) == [(7.0, "ab"), (None, "3")]


def test_zone_fields(spark):
    field = lambda schema, name: basin.zone_field(spark.createDataFrame([], schema), name)
    assert field("a double, Huc12 string, VALUE int", "HUC12") == "Huc12"
    assert field("a int, VALUE int, ZONE int", "HUC12") == "ZONE"
    assert field("a double, b date, c bigint, d string", "HUC12") == "c"
    with pytest.raises(RuntimeError, match="no usable zone field"):
        field("a double, value date", "HUC12")
