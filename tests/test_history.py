"""Histories in bucketed tables: lookups read one bucket, joins need no exchange."""

import uuid

import pytest
from pyspark.sql import functions as F

from arbora.operators import information, weights
from arbora.sources import history
from conftest import rows_of


def kept(spark, tmp_path, rows):
    name = f"h_{uuid.uuid4().hex}"
    history.write_history(spark.createDataFrame(rows, "t long, i int, j int, x double"), name, str(tmp_path / name), 8)
    return name


ROWS = [(t, i, j, t * 100.0 + 10 * i + j) for t in (*range(1, 40), history.STEPS - 1, history.STEPS, 3 * history.STEPS) for i in range(5) for j in range(i + 1, 5)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_edge_is_read_from_its_buckets(spark, tmp_path):
    name = kept(spark, tmp_path, [*ROWS, (7, 1, 3, -1.0), (None, 1, 3, -2.0)])
    one = history.edge_history(spark, name, 1, 3, 7, 7)
    assert sorted(r["x"] for r in one.collect()) == [-1.0, 713.0]
    want = [x for t, i, j, x in ROWS if (i, j) == (0, 4) and 30 <= t <= history.STEPS]
    assert sorted(r["x"] for r in history.edge_history(spark, name, 0, 4, 30, history.STEPS).collect()) == sorted(want)
    assert history.edge_history(spark, name, 4, 0, 1, 50).count() == 0
    # the other buckets aren't opened: nothing but the one that holds the edge can be read any more
    own = {r[0].rsplit("/", 1)[1] for r in one.select(F.input_file_name()).collect()}
    others = [f for f in (tmp_path / name).glob("*.parquet") if f.name not in own]
    assert len(own) == 1 and len(others) >= 4
    for f in others:
        f.write_bytes(b"none")
    spark.catalog.refreshTable(name)
    assert sorted(r["x"] for r in history.edge_history(spark, name, 1, 3, 7, 7).collect()) == [-1.0, 713.0]
    with pytest.raises(Exception, match="parquet"):
        spark.table(name).where("x = 713").collect()


def test_histories_are_joined_where_they_lie(spark, tmp_path):
    a, b = kept(spark, tmp_path, ROWS), kept(spark, tmp_path, ROWS[::2])
    both = history.side_by_side(spark, a, b)
    assert "Exchange" not in plan(both) and "SortMergeJoin" in plan(both)
    assert both.count() == len(ROWS[::2])
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    some = spark.createDataFrame([(t, i, j) for t, i, j, _ in ROWS[5:50]] + [(99, 0, 1)], "t long, i int, j int")
    assert rows_of(history.looked_up(some, a)) == rows_of(spark.createDataFrame(ROWS[5:50], "t long, i int, j int, x double"))
    empty = kept(spark, tmp_path, [])
    assert history.looked_up(some, empty).count() == 0 == history.side_by_side(spark, a, empty).count()


def test_grids_hold_what_rows_hold(spark, tmp_path):
    # steps are missing, values lie outside of the domain or are null, blocks and grids end in the middle
    rows = [(t, t * 7 % 3, t * 5 % 4 if t % 11 else None, t * 3 % 3) for t in range(1, 200) if t % 13 and not 64 <= t < 96]
    wide = spark.createDataFrame(rows, "t long, v0 int, v1 int, v2 int")
    a, b = f"h_{uuid.uuid4().hex}", f"h_{uuid.uuid4().hex}"
    w, p = weights.weight_grids(wide, 3, 3, 180, steps=32, grid=8), information.phi_grids(wide, 3, steps=32, grid=8)
    assert w.count() <= 3 * 25 >= p.count()
    history.write_grids(w, a, str(tmp_path / a), 8, 8)
    history.write_grids(p, b, str(tmp_path / b), 8, 8)
    both = history.grids_side_by_side(spark, a, b, 8)
    assert "Exchange" not in plan(both) and "SortMergeJoin" in plan(both)
    names = ["t", "i", "j", "log_weight", "phi", "cum_phi"]
    want = weights.weights_trajectory(wide, 3, 3, 180, steps=32).join(information.phi_trajectory(wide, 3, steps=32), ["t", "i", "j"])
    assert both.columns == names and rows_of(both) == rows_of(want.select(names))
    assert both.where("i = 0 and j = 1").count() < both.where("i = 0 and j = 2").count() == len(rows)
