import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in os.listdir(SF):
        con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{SF}/{p}'")
    return con


@pytest.fixture(scope="session")
def compare(spark, duck):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    def rows(names, data):
        order = sorted(range(len(names)), key=lambda k: names[k])
        return sorted((tuple(plain(r[k]) for k in order) for r in data), key=lambda r: tuple(map(str, r)))

    def check(query, sql):
        df = query(spark, SF)
        found = rows(df.columns, df.collect())
        rel = duck.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        assert found == rows(rel.columns, rel.fetchall())
        return found

    return check
