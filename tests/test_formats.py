"""Files as the session's own formats, bad records, and table functions."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arbora import queries
from arbora.functions import tables
from arbora.operators import information
from arbora.sources import files, formats
from arbora.sources.events import N, natural, planted
from conftest import DATA, rows_of


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


@pytest.mark.parametrize("split", [7, 100, 64 << 20])
def test_each_line_is_read_once_wherever_files_are_split(known, tmp_path, split):
    wide, path = planted(known, DATA).where("t <= 60"), str(tmp_path / "obs")
    wide.repartition(3).write.format("observations").mode("append").save(path)
    assert len(os.listdir(path)) == 3
    assert rows_of(known.read.format("observations").option("n", N).option("split", split).load(path)) == rows_of(wide)
    assert rows_of(files.read_observations(known, path, N)) == rows_of(wide)


def test_splits_of_files_that_others_wrote(known, tmp_path):
    """A last line without line feed, a file with a header only, an empty one, and names that are passed over."""
    for name, text in {"a.csv": ",0,1\n0,1,2\n1,2,1", "b.csv": ",0,1\n", "c.csv": "", "_d.csv": "x", ".e": "y"}.items():
        (tmp_path / name).write_text(text)
    for split in (1, 3, 5, 1000):
        got = known.read.format("observations").option("n", 2).option("split", split).load(str(tmp_path))
        assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (2, 2, 1)]


def test_a_failed_write_leaves_no_part(known, tmp_path):
    path = str(tmp_path / "obs")
    wide = planted(known, DATA).repartition(4)
    wide.where("t <= 50").write.format("observations").mode("append").save(path)
    before = sorted(os.listdir(path))
    fails = wide.withColumn("v0", F.when(F.col("t") == 777, F.raise_error(F.lit("no")).cast("int")).otherwise(F.col("v0")))
    with pytest.raises(Exception, match="no"):
        fails.write.format("observations").mode("append").save(path)
    assert sorted(os.listdir(path)) == before
    assert known.read.format("observations").option("n", N).load(path).count() == 50
    wide.where("t > 990").write.format("observations").mode("overwrite").save(path)
    assert known.read.format("observations").option("n", N).load(path).count() == 10


def test_edge_lists(known, tmp_path):
    e = known.createDataFrame([(i, i + k) for i in range(30) for k in (1, 2)], "i int, j int")
    e.repartition(2).write.format("edge_list").mode("append").save(str(tmp_path / "e"))
    assert rows_of(known.read.format("edge_list").load(str(tmp_path / "e"))) == rows_of(e) == rows_of(files.read_edges(known, str(tmp_path / "e")))


def test_bad_edges_come_out_by_place(spark, tmp_path):
    (tmp_path / "e.txt").write_text("[(0, 1), (a, 2), (3,),\n (4, 5), (6, 7, 8), (-1, 2), (9, None)]")
    good = files.quarantined_edges(spark, str(tmp_path / "e.txt"), str(tmp_path / "bad"))
    assert sorted(map(tuple, good.collect())) == [(-1, 2), (0, 1), (4, 5)]
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert sorted((r["item"], r["text"]) for r in bad) == [(1, "a, 2"), (2, "3,"), (4, "6, 7, 8"), (6, "9, None")]
    assert all(r["file"].endswith("e.txt") for r in bad)


def test_bad_rows_come_out_by_line(spark, tmp_path):
    (tmp_path / "o.csv").write_text(",0,1\n0,1,1\n1,x,0\n2,1\n3,,1\n4,2,0\n5,0,1,1\n6,0,0\n")
    good = files.quarantined_observations(spark, str(tmp_path / "o.csv"), 2, 2, str(tmp_path / "bad"))
    assert sorted(map(tuple, good.collect())) == [(1, 1, 1), (7, 0, 0)]
    bad = {(r["line"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert bad == {("1,x,0", "malformed"), ("2,1", "malformed"), ("3,,1", "missing"), ("4,2,0", "outside"), ("5,0,1,1", "malformed")}


def test_pair_scores_read_the_rows_once(spark):
    df = information.pair_scores(natural(spark, DATA), 4)
    mi = {(r["i"], r["j"]): r["mi"] for r in information.mutual_information(natural(spark, DATA)).collect()}
    phi = {(r["i"], r["j"]): r["cum_phi"] for r in information.phi_terminal(natural(spark, DATA), 4).collect()}
    rows = df.collect()
    assert {(r["i"], r["j"]): r["mi"] for r in rows} == pytest.approx(mi, abs=1e-9)
    assert {(r["i"], r["j"]): r["cum_phi"] for r in rows} == pytest.approx(phi, abs=1e-6)


def test_table_functions_draw_what_the_operators_draw(spark):
    from arbora.operators import trees

    tables.register(spark)
    w = queries.runs(queries.edges(spark, DATA), 5)
    sql = "SELECT * FROM determinant_tree(TABLE(SELECT run, i, j, ln(weight) AS log_weight FROM {w}) PARTITION BY run ORDER BY (i, j), 6, 3)"
    assert rows_of(spark.sql(sql, w=w)) == rows_of(trees.determinant_tree(w, 6, 3, 0.0, "run"))
    forest = spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 2, 1.0), (1, 1, 2, 1.5), (2, 7, 5, 1.0), (2, 5, 7, 3.0)], "run long, i int, j int, weight double")
    got = spark.sql("SELECT * FROM minimum_tree(TABLE({w}) PARTITION BY run ORDER BY (weight, i, j))", w=forest)
    assert rows_of(got) == Counter([(0, 2, 1), (1, 2, 1), (5, 7, 2)])  # columns by name: i, j, run
