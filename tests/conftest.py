import os
import sys
from collections import Counter

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else x + 0.0
    return tuple(x) if isinstance(x, list) else x


def rows_of(df):
    """Rows as a multiset of tuples, columns in order of their names."""
    names = sorted(df.columns)
    return Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")

    def run(sql):
        r = c.sql(sql)
        order = sorted(range(len(r.columns)), key=lambda k: r.columns[k])
        return sorted(r.columns), Counter(tuple(plain(row[k]) for k in order) for row in r.fetchall())

    return run
