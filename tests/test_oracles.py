"""A choice of queries against their SQL, on the smallest data that have complete years."""

import glob
import math
import os

import duckdb
import pytest

from rillspark import plans

SF = "/root/testdata/sf0.01"
CHOICE = ["fs5_missing_ranges", "fs19_colwell", "fs22_magnificent_seven", "fs12_pulses", "ts3_interpolate_gap", "ts17_month_values", "nm8_annualize_median", "nr5_backbone", "nr8_dendritic", "up3_route_mainstem", "ba8_mainstem", "ba15_push", "w8_run_ids", "cl8_davies_bouldin", "ct2_report",
          "cl8_silhouette", "cl9_dtw_matrix", "ct1_tree_predictions", "ct3_importances", "ba2_ring_shape", "j10_longest_by_geometry", "nr2_clip_shapes", "nr11_orphans_by_geometry", "pf13_multi", "io4_workbooks", "up9_upstream_with_self"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def text(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHOICE)
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*columns).collect())
    rows = duck.sql(f"SELECT {', '.join(columns)} FROM ({plans.ORACLES[name]})").fetchall()
    assert got == sorted(tuple(map(text, r)) for r in rows)


def test_every_oracle_has_a_query():
    assert set(plans.ORACLES) <= set(plans.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
