import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
import raggedlake.queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    r = duck.execute(q.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


def test_entry(spark):
    assert "eval_revenue" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 3


def test_set_from_reads_every_user(spark, tmp_path):
    from raggedlake.queries import QUERIES

    spark.range(40).selectExpr("id AS event_id", "100 + id % 8 AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["rid"], r["pos"]): r["value"] for r in QUERIES["set_from"](spark, str(tmp_path)).collect()}
    assert [got[0, k] for k in range(5)] == [0, 8, 16, 24, 32] and (got[4, 0], got[5, 0], got[6, 0]) == (4, 1, 3)
