"""One query per operator over the provided tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raggedlake.operators import encoded, jagged, waveform
from raggedlake.operators.histogram import Axis, Histogram
from raggedlake.operators.table import Struct, Table
from raggedlake.plans.session import scratch_dir, table
from raggedlake.schema import KIND, RID
from raggedlake.sources import interop

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _events(s: SparkSession, d: str) -> Table:
    return Table.of(table(s, d, "events").select("event_id", "event_type", "user_id", "value"), "event_id")


def _customers(s: SparkSession, d: str) -> Table:
    return Table.of(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")


def _rid(t: Table) -> DataFrame:
    return t.df.withColumnRenamed(RID, "rid")


def _per_order(s: SparkSession, d: str) -> DataFrame:
    return jagged.build(table(s, d, "lineitem"), ["l_orderkey"], ["l_linenumber"], "l_quantity", "q")


def _free(s: SparkSession, d: str, name: str) -> Table:
    """Rows without order: row-wise operators need no positions."""
    return Table(table(s, d, name).withColumn(RID, F.lit(None).cast("bigint")))


V = "WITH v AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) q FROM lineitem GROUP BY 1) "
EV = "WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 rid, event_id, event_type, user_id, value FROM events) "
CU = "WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 rid, c_custkey, c_name, c_acctbal FROM customer) "

# expressions


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def eval_revenue(s, d):
    t = _free(s, d, "lineitem").with_column("revenue", "l_extendedprice * (1 - l_discount)")
    return t.df.select("l_orderkey", "l_linenumber", "revenue")


@query("SELECT l_orderkey, l_linenumber, ((l_quantity - l_tax) > 20 AND (l_discount * 100 < 5)) AS flag FROM lineitem")
def eval_predicate(s, d):
    t = _free(s, d, "lineitem").with_column("flag", "((l_quantity - l_tax) > 20) & (l_discount * 100 < 5)")
    return t.df.select("l_orderkey", "l_linenumber", "flag")


@query("SELECT round(sum(l_quantity) + max(l_discount) * 2, 2) AS total FROM lineitem")
def eval_reduce(s, d):
    node = _free(s, d, "lineitem")._compiler().compile("np.sum(l_quantity) + np.max(l_discount) * 2")
    return table(s, d, "lineitem").agg(F.round(node.col, 2).alias("total"))


@query("SELECT c_custkey, round(sin(c_acctbal), 6) AS s, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) WHEN c_acctbal = 0 THEN '-inf'::DOUBLE ELSE NULL END AS l FROM customer")
def eval_functions(s, d):
    t = _free(s, d, "customer").with_column("s", "sin(c_acctbal)").with_column("l", "log(c_acctbal)")
    return t.df.select("c_custkey", F.round("s", 6).alias("s"), F.nanvl(F.round("l", 6), F.lit(None)).alias("l"))


@query("SELECT p_partkey, p_size::BIGINT * p_size AS square, (p_size // 7)::BIGINT AS whole, (p_size % 7)::BIGINT AS rest, p_size / 4.0::DOUBLE AS quarter FROM part")
def eval_integers(s, d):
    t = _free(s, d, "part")
    for name, text in (("square", "p_size**2"), ("whole", "p_size // 7"), ("rest", "p_size % 7"), ("quarter", "p_size / 4")):
        t = t.with_column(name, text)
    return t.df.select("p_partkey", "square", "whole", "rest", "quarter")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice ELSE -1.0::DOUBLE END AS price FROM part")
def eval_where(s, d):
    return _free(s, d, "part").with_column("price", "where(p_size > 25, p_retailprice, -1)").df.select("p_partkey", "price")


@query("SELECT l_orderkey, l_linenumber, l_quantity * (1 + l_tax) AS gross FROM lineitem")
def eval_nested(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_quantity", F.struct("l_tax").alias("rates")).alias("item"), F.lit(None).cast("bigint").alias(RID))
    return Table(df).with_column("gross", "item__l_quantity * (1 + item__rates__l_tax)").df.select("l_orderkey", "l_linenumber", "gross")


@query("SELECT c_custkey, c_acctbal * 2 AS scaled FROM customer")
def eval_parameters(s, d):
    class Args:
        value = 2

    return _free(s, d, "customer").with_column("scaled", "c_acctbal * args.value", {"args": Args}).df.select("c_custkey", "scaled")


@query("SELECT c_custkey, c_acctbal * c_acctbal AS square FROM customer")
def eval_python_function(s, d):
    class Own:
        @staticmethod
        def square(x):
            return x * x

    return _free(s, d, "customer").with_column("square", "own.square(c_acctbal)", modules={"own": Own}).df.select("c_custkey", "square")


@query("SELECT c_custkey, c_acctbal - (SELECT max(c_acctbal) FROM customer) AS gap FROM customer")
def eval_against_total(s, d):
    return _free(s, d, "customer").with_column("gap", "c_acctbal - np.max(c_acctbal)").df.select("c_custkey", "gap")


@query("WITH r AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 rid, r_regionkey::BIGINT k FROM region), v AS (SELECT list(k ORDER BY rid) l FROM r) SELECT rid, u.j - 1 AS pos, (rid * 10 + u.j - 1 + v.l[u.j])::BIGINT AS value FROM r, v, unnest(range(1, 6)) u(j)")
def eval_last_axis(s, d):
    t = Table.of(table(s, d, "region").select(F.col("r_regionkey").cast("bigint").alias("a")), "a")
    wide = t.add("w", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: (F.col(RID) * 10 + j).cast("bigint")))
    wide = Table(wide.df.withMetadata("w", {KIND: "equalsized", "shape": [5]}))
    return wide.eval("a + w").df.select(F.col(RID).alias("rid"), F.posexplode("value").alias("pos", "value"))


@query("SELECT p_partkey, p_size::BIGINT * 94906267 // 10 AS tenth, (p_size::BIGINT + 94906266) * (p_size::BIGINT + 94906266) AS square, 9223372036854775807 // p_size::BIGINT AS most, (p_size % 5)::BIGINT * (p_size % 5) * (p_size % 5) AS cube FROM part")
def eval_big_integers(s, d):
    t = _free(s, d, "part")
    for name, text in (("tenth", "p_size * 94906267 // 10"), ("square", "(p_size + 94906266)**2"), ("most", "9223372036854775807 // p_size"), ("cube", "(p_size % 5)**(1 + 2)")):
        t = t.with_column(name, text)
    return t.df.select("p_partkey", "tenth", "square", "most", "cube")


@query("SELECT -count(*) + 2 AS n, sum(p_size) * -1 AS total FROM part")
def eval_scalar_minus(s, d):
    t = _free(s, d, "part")
    n, total = t.eval("np.count(p_size) * -1 + (1 + 1)"), t.eval("np.sum(p_size) * -1")
    return s.createDataFrame([(n.value, total.value)], "n bigint, total bigint")


@query("SELECT vec_id, (i - 1)::INT AS pos, embedding[i]::DOUBLE * -1 * 2 AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i)")
def eval_wide_constants(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"), F.lit(None).cast("bigint").alias(RID)).withMetadata("w", {KIND: "equalsized", "shape": [64]})
    return jagged.flattened(Table(e).with_column("v", "w * -1 * (1 + 1)").df, "v", ["vec_id"])


@query("SELECT unnest(['np', 'ak', 'lgdo']) AS library, (SELECT sum(p_size) FROM part)::BIGINT AS total")
def eval_library(s, d):
    t = _free(s, d, "part")
    return s.createDataFrame([(x, t.eval("np.sum(p_size)", library=x).value) for x in ("np", "ak", "lgdo")], "library string, total bigint")


# selection by position


@query("SELECT event_id, value FROM events")
def select_columns(s, d):
    return _free(s, d, "events").select(["event_id", "value"]).df.drop(RID)


@query(EV + "SELECT (rid - 10) // 3 AS rid, event_id, value FROM e WHERE rid >= 10 AND rid < 500 AND (rid - 10) % 3 = 0")
def row_slice(s, d):
    return _rid(_events(s, d)[10:500:3]).select("rid", "event_id", "value")


@query(EV + "SELECT (SELECT count(*) FROM events) - 1 - rid AS rid, event_id FROM e")
def row_reverse(s, d):
    return _rid(_events(s, d)[::-1]).select("rid", "event_id")


@query(EV + "SELECT p.pos AS rid, event_id, value FROM e JOIN (VALUES (0, 7), (1, 3), (2, 3), (3, 40)) p(pos, idx) ON e.rid = p.idx")
def row_take(s, d):
    return _rid(_events(s, d)[[7, 3, 3, 40]]).select("rid", "event_id", "value")


@query(EV + "SELECT row_number() OVER (ORDER BY rid) - 1 AS rid, event_id, value FROM e WHERE value > 50 AND event_type <> 'click'")
def row_mask(s, d):
    t = _events(s, d)
    return _rid(t[(F.col("value") > 50) & (F.col("event_type") != "click")]).select("rid", "event_id", "value")


@query(EV + "SELECT event_id, event_type, user_id, value FROM e WHERE rid = 17")
def row_get(s, d):
    return _events(s, d).slice(17, 18).df.drop(RID)


@query(EV + "SELECT event_id, event_type, user_id, value FROM e WHERE rid = 17 UNION ALL SELECT event_id, event_type, user_id, value FROM e WHERE rid = (SELECT max(rid) FROM e)")
def row_at(s, d):
    t = _events(s, d)
    rows = [tuple(t.row(i)[c].value for c in t.columns) for i in (17, -1)]
    return s.createDataFrame(rows, t.schema)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def rows_iterated(s, d):
    t = Table.of(table(s, d, "nation").select(F.col("n_nationkey").cast("bigint"), "n_name"), "n_nationkey")
    return s.createDataFrame([tuple(r) for r in t.rows()], "n_nationkey bigint, n_name string")


@query(EV + "SELECT rid, event_id, CASE WHEN rid IN (1, 5) THEN -1.0::DOUBLE ELSE value END AS value FROM e")
def row_assign(s, d):
    return _rid(_events(s, d).assign("value", [1, 5], -1.0)).select("rid", "event_id", "value")


# editing rows

_NEW = {"c_custkey": -1, "c_name": "new", "c_acctbal": 1.5}


@query(CU + "SELECT rid, c_custkey, c_name, c_acctbal FROM c UNION ALL SELECT (SELECT count(*) FROM c), -1, 'new', 1.5::DOUBLE")
def rows_append(s, d):
    return _rid(_customers(s, d).append(_NEW))


@query(CU + "SELECT CASE WHEN rid >= 3 THEN rid + 2 ELSE rid END AS rid, c_custkey, c_name, c_acctbal FROM c UNION ALL SELECT x, -1, 'new', 1.5::DOUBLE FROM (VALUES (3), (4)) v(x)")
def rows_insert(s, d):
    return _rid(_customers(s, d).insert(3, [_NEW, _NEW]))


@query(CU + "SELECT rid, CASE WHEN rid = 2 THEN -1 ELSE c_custkey END AS c_custkey, CASE WHEN rid = 2 THEN 'new' ELSE c_name END AS c_name, CASE WHEN rid = 2 THEN 1.5::DOUBLE ELSE c_acctbal END AS c_acctbal FROM c")
def rows_replace(s, d):
    return _rid(_customers(s, d).replace(2, _NEW))


@query(CU + "SELECT rid, c_custkey, c_name, c_acctbal FROM c WHERE rid < 100")
def rows_shrink(s, d):
    return _rid(_customers(s, d).resize(100))


@query("WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 rid, n_nationkey, n_name FROM nation) SELECT rid, n_nationkey, n_name FROM n UNION ALL SELECT range, 0, '' FROM range(25, 40)")
def rows_grow(s, d):
    return _rid(Table.of(table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").resize(40))


@query("SELECT count(*) AS n FROM nation WHERE false")
def rows_clear(s, d):
    return Table.of(table(s, d, "nation"), "n_nationkey").clear().df.agg(F.count(F.lit(1)).alias("n"))


# positional joins

_SU = "WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 rid, c_custkey, c_acctbal FROM customer), u AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 rid, s_suppkey, s_acctbal AS c_acctbal FROM supplier) "


def _pair(s, d):
    left = Table.of(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    right = Table.of(table(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("c_acctbal")), "s_suppkey")
    return left, right


@query(_SU + "SELECT c.rid, c_custkey, coalesce(s_suppkey, 0) AS s_suppkey, coalesce(u.c_acctbal, 0) AS c_acctbal FROM c LEFT JOIN u USING (rid)")
def zip_join(s, d):
    left, right = _pair(s, d)
    return _rid(left.join(right))


@query(_SU + "SELECT c.rid, c_custkey, c.c_acctbal, coalesce(s_suppkey, 0) AS s_suppkey FROM c LEFT JOIN u USING (rid)")
def zip_join_keep_mine(s, d):
    left, right = _pair(s, d)
    return _rid(left.join(right, keep_mine=True))


@query(_SU + "SELECT c.rid, c_custkey, c.c_acctbal, coalesce(u.c_acctbal, 0) AS s_c_acctbal_2 FROM c LEFT JOIN u USING (rid)")
def zip_join_prefix(s, d):
    left, right = _pair(s, d)
    return _rid(left.join(right, cols="c_acctbal", prefix="s_", suffix="_2"))


# nested tables


@query("SELECT c_custkey, c_acctbal AS money__balance, c_nationkey AS money__place__nation FROM customer")
def nested_flatten(s, d):
    df = table(s, d, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("balance"), F.struct(F.col("c_nationkey").alias("nation")).alias("place")).alias("money"), F.lit(None).cast("bigint").alias(RID))
    return Table(df).flatten().df.drop(RID)


@query("SELECT c_custkey, c_acctbal AS money__balance, c_acctbal * 2 AS money__deep__double FROM customer")
def nested_add_remove(s, d):
    df = table(s, d, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("balance"), "c_name").alias("money"), F.lit(None).cast("bigint").alias(RID))
    t = Table(df).update({"money": {"deep": {"double": F.col("money.balance") * 2}}}).remove("money/c_name")
    return t.flatten().df.drop(RID)


@query("SELECT unnest(['c_custkey:array<1>{real}', 'q:array<1>{array<1>{real}}', 'm:table{a,b}', 'w:array_of_equalsized_arrays<1,1>{real}']) AS line")
def datatype_strings(s, d):
    df = table(s, d, "customer").select("c_custkey", F.array("c_acctbal").alias("q"), F.struct(F.lit(1).alias("b"), F.lit("x").alias("a")).alias("m"), F.array("c_acctbal").alias("w"), F.lit(None).cast("bigint").alias(RID)).withMetadata("w", {KIND: "equalsized", "shape": [1]})
    t = Table(df)
    return s.createDataFrame([(f"{c}:{t.datatype_of(c)}",) for c in t.columns], "line string")


# jagged arrays


@query(V + "SELECT l_orderkey, (i - 1)::INT AS pos, q[i] AS value FROM v, unnest(range(1, len(q) + 1)) u(i)")
def vov_explode(s, d):
    return jagged.flattened(_per_order(s, d), "q", ["l_orderkey"])


@query(V + ", n AS (SELECT row_number() OVER (ORDER BY l_orderkey) - 1 rid, len(q) n FROM v) SELECT rid, n::BIGINT AS length, sum(n) OVER (ORDER BY rid)::BIGINT AS cl FROM n")
def vov_lengths(s, d):
    t = Table.of(_per_order(s, d), "l_orderkey")
    return jagged.cumulative_lengths(t, "q").df.join(jagged.lengths(t, "q").df, RID).select(F.col(RID).alias("rid"), "length", "cl")


@query("WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 p, value FROM events), r AS (SELECT range AS rid FROM range((SELECT (count(*) + 6) // 7 FROM events))) SELECT rid, (p - rid * 7)::INT AS pos, value FROM r JOIN e ON p >= rid * 7 AND p < rid * 7 + 7")
def vov_from_lengths(s, d):
    flat = _events(s, d).select(["value"])
    n = -(-len(flat) // 7)
    cl = Table(s.range(n).select(F.col("id").alias(RID), F.least((F.col("id") + 1) * 7, F.lit(len(flat))).alias("cl")))
    got = jagged.from_lengths(flat, cl)
    return jagged.flattened(got.df, "values", [RID]).withColumnRenamed(RID, "rid")


@query("WITH t AS (SELECT event_id, CASE WHEN event_type <> lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END c FROM events), u AS (SELECT event_id, sum(c) OVER (ORDER BY event_id) run FROM t) SELECT run::BIGINT AS run, count(*)::BIGINT AS length, sum(count(*)) OVER (ORDER BY run)::BIGINT AS cl FROM u GROUP BY run")
def run_lengths(s, d):
    return jagged.run_lengths(_events(s, d), "event_type").df.select(F.col(RID).alias("run"), "length", "cl")


@query("WITH n AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row, p_size % 4 AS n FROM part) SELECT row, i AS pos FROM n, unnest(range(n)) u(i)")
def explode_lengths(s, d):
    return jagged.explode_lengths(Table.of(table(s, d, "part").select("p_partkey", (F.col("p_size") % 4).alias("n")), "p_partkey"), "n")


@query("SELECT p_partkey, p_retailprice, i AS pos FROM part, unnest(range(p_size % 4)) u(i)")
def explode_columns(s, d):
    return jagged.explode_columns(table(s, d, "part").withColumn("n", F.col("p_size") % 4), "n", ["p_partkey", "p_retailprice"])


@query(V + "SELECT l_orderkey, i::INT AS pos, q[i + 1] AS value FROM v, unnest(range((SELECT max(len(q)) FROM v))) u(i)")
def pad_nan(s, d):
    rows = jagged.flattened(jagged.pad(_per_order(s, d), "q"), "q", ["l_orderkey"])
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@query(V + "SELECT l_orderkey, i::INT AS pos, coalesce(q[i + 1], -1) AS value FROM v, unnest(range(3)) u(i)")
def pad_fill(s, d):
    return jagged.flattened(jagged.pad(_per_order(s, d), "q", 3, -1.0), "q", ["l_orderkey"])


@query("SELECT vec_id, (i - 1)::INT AS pos, embedding[i] AS value FROM embeddings, unnest(range(1, vec_id % 5 + 1)) u(i)")
def cut_equal_sized(s, d):
    df = table(s, d, "embeddings").select("vec_id", "embedding").withMetadata("embedding", {KIND: "equalsized", "shape": [64]})
    return jagged.flattened(jagged.cut(df, "embedding", F.col("vec_id") % 5), "embedding", ["vec_id"])


@query(V + "SELECT l_orderkey, (i - 1)::INT AS pos, 2 * q[i] + 1 AS value FROM v, unnest(range(1, len(q) + 1)) u(i)")
def jagged_affine(s, d):
    t = Table(_per_order(s, d).withColumn(RID, F.lit(None).cast("bigint"))).with_column("r", "2*q + 1")
    return jagged.flattened(t.df, "r", ["l_orderkey"])


@query(V + "SELECT l_orderkey, (i - 1)::INT AS pos, l_orderkey + q[i] AS value FROM v, unnest(range(1, len(q) + 1)) u(i)")
def jagged_broadcast(s, d):
    t = Table(_per_order(s, d).withColumn(RID, F.lit(None).cast("bigint"))).with_column("r", "l_orderkey + q")
    return jagged.flattened(t.df, "r", ["l_orderkey"])


@query(V + "SELECT l_orderkey, (i - 1)::INT AS pos, q[i] > 25 AS value FROM v, unnest(range(1, len(q) + 1)) u(i)")
def jagged_compare(s, d):
    t = Table(_per_order(s, d).withColumn(RID, F.lit(None).cast("bigint"))).with_column("r", "q > 25")
    return jagged.flattened(t.df, "r", ["l_orderkey"])


@query("WITH o AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) q FROM lineitem GROUP BY 1) SELECT (l_orderkey // 10)::BIGINT AS g, sum(2 * list_sum(q) + len(q)) AS total FROM o GROUP BY 1")
def jagged_deep(s, d):
    df = jagged.build(_per_order(s, d).withColumn("g", F.floor(F.col("l_orderkey") / 10)), ["g"], ["l_orderkey"], "q", "qq")
    t = Table(df.withColumn(RID, F.lit(None).cast("bigint"))).with_column("r", "2*qq + 1")
    return t.with_column("total", "ak.sum(ak.flatten(r), axis=-1)").df.select("g", "total")


@query(V + "SELECT l_orderkey, list_sum(q) AS total, len(q)::BIGINT AS n, list_max(q) AS most FROM v")
def jagged_rowsum(s, d):
    t = Table(_per_order(s, d).withColumn(RID, F.lit(None).cast("bigint")))
    for name, text in (("total", "ak.sum(q, axis=-1)"), ("n", "ak.num(q)"), ("most", "ak.max(q, axis=-1)")):
        t = t.with_column(name, text)
    return t.df.select("l_orderkey", "total", "n", "most")


@query("SELECT sum(l_quantity) + count(*) AS total FROM lineitem")
def jagged_total(s, d):
    df = _per_order(s, d)
    node = Table(df.withColumn(RID, F.lit(None).cast("bigint")))._compiler().compile("ak.sum(q) + ak.count(q)")
    return df.agg(node.col.alias("total"))


@query("WITH v AS (SELECT user_id, list(event_id ORDER BY event_id) q FROM events GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY user_id) - 1 rid, q FROM v), a AS (SELECT rid, q FROM n WHERE rid < 5 UNION ALL SELECT 5, [1, 2] UNION ALL SELECT 6, [3, -9223372036854775808, -9223372036854775808]) SELECT rid, (i - 1)::INT AS pos, q[i]::BIGINT AS value FROM a, unnest(range(1, len(q) + 1)) u(i)")
def set_from(s, d):
    t = Table.of(jagged.build(table(s, d, "events"), ["user_id"], ["event_id"], "event_id", "q"), "user_id")
    return jagged.flattened(jagged.set_from(t, "q", 5, [[1, 2], [3]], [2, 3]).df, "q", [RID]).withColumnRenamed(RID, "rid")


@query(V + ", n AS (SELECT row_number() OVER (ORDER BY l_orderkey) - 1 rid, l_orderkey, q FROM v) SELECT (rid - 3) // 2 AS rid, (i - 1)::INT AS pos, q[i] AS value FROM n, unnest(range(1, len(q) + 1)) u(i) WHERE rid >= 3 AND (rid - 3) % 2 = 0")
def vov_slice(s, d):
    t = Table.of(_per_order(s, d), "l_orderkey")
    return jagged.flattened(t[3::2].df, "q", [RID]).withColumnRenamed(RID, "rid")


@query(V + ", n AS (SELECT row_number() OVER (ORDER BY l_orderkey) - 1 rid, q FROM v) SELECT rid, (i - 1)::INT AS pos, CASE WHEN rid = 4 THEN i * 0.5::DOUBLE ELSE q[i] END AS value FROM n, unnest(range(1, CASE WHEN rid = 4 THEN 10 ELSE len(q) + 1 END)) u(i)")
def vov_assign_row(s, d):
    t = Table.of(_per_order(s, d), "l_orderkey").select(["q"]).replace(4, {"q": [0.5 * i for i in range(1, 10)]})
    return jagged.flattened(t.df, "q", [RID]).withColumnRenamed(RID, "rid")


# histograms


@query("SELECT r.range::INT AS bin_0, coalesce(w, 0)::BIGINT AS weight FROM range(10) r LEFT JOIN (SELECT floor(l_quantity / 5.0::DOUBLE)::INT b, count(*) w FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 GROUP BY 1) ON b = r.range")
def hist_range(s, d):
    return Histogram.make([(0, 50, 5)]).fill(table(s, d, "lineitem"), ["l_quantity"]).dense(s)


@query("SELECT r.range::INT AS bin_0, coalesce(w, 0)::BIGINT AS weight FROM range(10) r LEFT JOIN (SELECT (ceil(l_quantity / 5.0::DOUBLE) - 1)::INT b, count(*) w FROM lineitem WHERE l_quantity > 0 AND l_quantity <= 50 GROUP BY 1) ON b = r.range")
def hist_right_closed(s, d):
    return Histogram.make([Axis(first=0, last=50, step=5, closedleft=False)]).fill(table(s, d, "lineitem"), ["l_quantity"]).dense(s)


@query("SELECT r.range::INT AS bin_0, coalesce(w, 0)::BIGINT AS weight FROM range(4) r LEFT JOIN (SELECT (len(list_filter([0.0::DOUBLE, 3.0, 10.0, 25.0, 50.0], lambda z: z <= l_quantity)) - 1)::INT b, count(*) w FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 GROUP BY 1) ON b = r.range")
def hist_variable(s, d):
    return Histogram.make([[0.0, 3.0, 10.0, 25.0, 50.0]]).fill(table(s, d, "lineitem"), ["l_quantity"]).dense(s)


@query("SELECT floor(l_quantity / 0.25::DOUBLE)::INT AS bin_0, count(*)::BIGINT AS weight FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 GROUP BY 1")
def hist_many_edges(s, d):
    return Histogram.make([[i / 4 for i in range(201)]]).count(table(s, d, "lineitem"), ["l_quantity"])


@query("SELECT a.range::INT AS bin_0, b.range::INT AS bin_1, round(coalesce(w, 0), 2) AS weight FROM range(5) a CROSS JOIN range(11) b LEFT JOIN (SELECT floor(l_quantity / 10.0::DOUBLE)::INT x, floor(l_discount / 0.01::DOUBLE)::INT y, sum(l_extendedprice) w FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 AND l_discount >= 0 AND l_discount < 0.11::DOUBLE GROUP BY 1, 2) ON x = a.range AND y = b.range")
def hist_2d_weighted(s, d):
    h = Histogram.make([(0, 50, 10), (0, 0.11, 0.01)]).fill(table(s, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return h.dense(s).withColumn("weight", F.round("weight", 2))


@query("SELECT r.range::INT AS bin_0, coalesce(w, 0)::BIGINT AS weight FROM range(4) r LEFT JOIN (SELECT floor((value - 20) / 10.0::DOUBLE)::INT b, count(*) w FROM events WHERE value >= 20 AND value < 60 GROUP BY 1) ON b = r.range")
def hist_outliers(s, d):
    e = table(s, d, "events")
    odd = e.select(F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))).alias("value"))
    return Histogram.make([(20, 60, 10)]).fill(e.select("value").unionByName(odd), ["value"]).dense(s)


@query("SELECT floor(l_quantity / 5.0::DOUBLE)::INT AS bin_0, 2 * count(*)::BIGINT AS weight FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 GROUP BY 1")
def hist_twice(s, d):
    li = table(s, d, "lineitem")
    return Histogram.make([(0, 50, 5)]).fill(li, ["l_quantity"]).fill(li, ["l_quantity"]).counts


@query("SELECT r.range::INT AS bin_0, coalesce(w, 0)::BIGINT AS weight FROM range(5) r LEFT JOIN (SELECT floor(p_size / 10.0::DOUBLE)::INT b, count(*) w FROM part WHERE p_size >= 0 AND p_size < 50 GROUP BY 1) ON b = r.range")
def hist_arrays(s, d):
    sizes = table(s, d, "part").select("p_size").toPandas()
    by_key = Histogram.make([(0, 50, 10)], spark=s).fill({"other": [], "size": sizes["p_size"].to_numpy()}, ["size"])
    frame = Histogram.make([(0, 50, 10)], spark=s).fill(sizes)
    assert (by_key.weights == frame.weights).all()
    return frame.dense(s)


@query("SELECT i::INT AS edge, 2.5::DOUBLE * i AS value FROM range(21) t(i)")
def axis_edges(s, d):
    a = Axis.from_range_edges([2.5 * i for i in range(21)])
    return s.createDataFrame([(i, float(e)) for i, e in enumerate(a.all_edges)], "edge int, value double")


# waveforms, equal-sized, encoded and interchange


@query("SELECT vec_id, (i - 1)::INT AS i, 0.5::DOUBLE * vec_id + (i - 1) * 2.0::DOUBLE AS time, embedding[i] AS value FROM embeddings, unnest(range(1, 65)) u(i)")
def waveform_samples(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return waveform.samples(waveform.add_waveform(e, "wf", F.col("embedding"), F.col("vec_id") * 0.5, 2.0, "ns", "ns"), "wf", ["vec_id"])


@query("SELECT vec_id, (i - 1)::INT AS i, CASE WHEN i <= 64 THEN embedding[i] ELSE 0 END AS value FROM embeddings, unnest(range(1, 67)) u(i)")
def waveform_length(s, d):
    e = waveform.add_waveform(table(s, d, "embeddings").select("vec_id", "embedding"), "wf", F.col("embedding"))
    return waveform.samples(waveform.set_length(e, "wf", 66), "wf", ["vec_id"]).drop("time")


@query("SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(embedding)::DOUBLE, 3) + 0.0 AS total FROM embeddings")
def equal_sized(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn(RID, F.lit(None).cast("bigint")).withMetadata("embedding", {KIND: "equalsized", "shape": [64]})
    t = Table(e).with_column("n", "ak.num(embedding)").with_column("total", "np.sum(embedding, axis=-1)")
    return t.df.select("vec_id", "n", (F.round("total", 3) + 0.0).alias("total"))


@query("SELECT doc_id, strlen(text)::BIGINT AS encoded_size, n_chars AS decoded_size FROM documents")
def encoded_sizes(s, d):
    docs = encoded.add_encoded(table(s, d, "documents"), "e", F.col("text").cast("binary"), F.col("n_chars"), "utf8")
    return encoded.sizes(docs, "e", ["doc_id"])


@query("SELECT doc_id, strlen(text)::BIGINT AS encoded_size, 99::BIGINT AS decoded_size FROM documents")
def encoded_common_size(s, d):
    return encoded.sizes(encoded.add_encoded(table(s, d, "documents"), "e", F.col("text").cast("binary"), 99), "e", ["doc_id"])


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def arrow_round_trip(s, d):
    t = Table.of(table(s, d, "nation").select(F.col("n_nationkey").cast("bigint"), "n_name", F.col("n_regionkey").cast("bigint")), "n_nationkey")
    return interop.from_arrow(s, interop.to_arrow(t)).df.drop(RID)


@query("SELECT range AS rid, 7::BIGINT AS value FROM range(1000)")
def filled_column(s, d):
    return _rid(interop.filled(s, 1000, 7)).withColumn("value", F.col("value").cast("bigint"))


@query("SELECT c_custkey AS id, c_custkey * 2 AS twice FROM customer")
def detector_ids(s, d):
    df = interop.detector_ids(table(s, d, "customer").select(F.col("c_custkey").alias("id")), "id")
    return df.select("id", (F.col("id") * 2).alias("twice"))


@query("SELECT c_custkey AS v_c_custkey, c_acctbal AS v_m_balance FROM customer")
def pandas_view(s, d):
    df = table(s, d, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("balance")).alias("m"), F.col("c_custkey").alias(RID))
    return interop.view(Table(df), prefix="v_")


# tables from and to the driver: these are about small tables, so all rows of nation or region travel

_NA = "WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 rid, n_nationkey::BIGINT n_nationkey, n_name, n_regionkey::BIGINT n_regionkey FROM nation) "


def _nations(s: SparkSession, d: str) -> Table:
    return Table.of(table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey")), "n_nationkey")


def _by_region(s: SparkSession, d: str) -> Table:
    return Table.of(jagged.build(_nations(s, d).df, ["n_regionkey"], ["n_nationkey"], "n_nationkey", "k"), "n_regionkey")


@query(_NA + "SELECT rid, n_nationkey, n_name FROM n")
def columns_from_arrays(s, d):
    rows = _nations(s, d).ordered().toPandas()
    return _rid(interop.from_columns(s, {"n_nationkey": rows["n_nationkey"].to_numpy(), "n_name": rows["n_name"].tolist()}))


@query(_NA + "SELECT rid, n_nationkey, n_name, n_regionkey FROM n")
def columns_from_pandas(s, d):
    return _rid(interop.from_pandas(s, _nations(s, d).ordered().toPandas()))


@query(_NA + ", g AS (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) k FROM n GROUP BY 1) SELECT n_regionkey AS rid, (i - 1)::INT AS pos, k[i] AS value FROM g, unnest(range(1, len(k) + 1)) u(i)")
def arrays_from_lists(s, d):
    lists = [list(r[0]) for r in _by_region(s, d).df.orderBy(RID).select("k").collect()]
    return jagged.flattened(interop.from_columns(s, {"k": lists}).df, "k", [RID]).withColumnRenamed(RID, "rid")


@query(_NA + "SELECT rid, i::INT AS pos, n_nationkey + i AS value, 'array_of_equalsized_arrays<1,1>{real}' AS datatype FROM n, range(3) t(i)")
def arrow_fixed_lists(s, d):
    keys = _nations(s, d).ordered().toArrow()["n_nationkey"].to_numpy()
    wide = pa.FixedSizeListArray.from_arrays(pa.array((keys[:, None] + np.arange(3)).ravel()), 3)
    t = interop.from_arrow(s, wide, "v")
    return jagged.flattened(t.df, "v", [RID]).withColumnRenamed(RID, "rid").withColumn("datatype", F.lit(t.datatype_of("v")))


@query(_NA + "SELECT rid, n_nationkey AS value FROM n")
def arrow_chunks(s, d):
    keys = _nations(s, d).ordered().toArrow()["n_nationkey"].combine_chunks()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)  # two chunks are joined
        return _rid(interop.from_arrow(s, pa.chunked_array([keys[:10], keys[10:]])))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'keV' AS units, 'array<1>{real}' AS datatype, 'nations' AS title FROM nation")
def attrs_round_trip(s, d):
    t = _nations(s, d).setattrs("n_nationkey", units="keV")
    t = interop.from_arrow(s, interop.to_arrow(Table(t.df, {"title": "nations"})))
    a = t.getattrs("n_nationkey", datatype=True)
    return t.df.select("n_nationkey", F.lit(a["units"]).alias("units"), F.lit(a["datatype"]).alias("datatype"), F.lit(t.getattrs()["title"]).alias("title"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def file_round_trip(s, d):
    path = f"{scratch_dir(s)}/table-{uuid.uuid4().hex}"
    interop.write(_customers(s, d), path)
    return interop.read(s, path).df.drop(RID)


@query(_NA + "SELECT n_nationkey AS key, n_name AS name, 'struct{key,name}' AS datatype FROM n WHERE rid = 3")
def struct_members(s, d):
    row = _nations(s, d).row(3)
    got = Struct({"key": row["n_nationkey"], "name": row["n_name"]})
    return s.createDataFrame([(got["key"].value, got.name.value, got.datatype)], "key bigint, name string, datatype string")


@query(_NA + "SELECT rid, CASE WHEN rid = 2 THEN 'other' ELSE n_name END AS text, CASE WHEN rid = 2 THEN 5 ELSE length(n_name) END::BIGINT AS size FROM n")
def encoded_rows(s, d):
    t = _nations(s, d)
    t = Table(encoded.add_encoded(t.df, "e", F.col("n_name").cast("binary"), F.length("n_name")))
    t = encoded.set_row(t, "e", 2, b"other", 5)
    assert encoded.get(t, "e", 2) == (b"other", 5)
    rows = [(i, data.decode(), size) for i, (data, size) in enumerate(encoded.iterate(t, "e"))]
    return s.createDataFrame(rows, "rid bigint, text string, size bigint")


@query(_NA + ", g AS (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) k FROM n GROUP BY 1) SELECT n_regionkey AS rid, i::INT AS pos, coalesce(k[i + 1], -1) AS value FROM g, unnest(range((SELECT max(len(k)) FROM g))) u(i)")
def numpy_view(s, d):
    got = interop.view_as(_by_region(s, d), "np", ["k"], fill=-1)
    return s.createDataFrame([(i, j, int(v)) for (i, j), v in np.ndenumerate(got)], "rid bigint, pos int, value bigint")


@query(_NA + "SELECT rid, n_nationkey AS key, 'm' AS units FROM n")
def units_view(s, d):
    t = _nations(s, d).setattrs("n_nationkey", units="m")
    got = interop.view_as(t, "pd", ["n_nationkey"], with_units=True)
    return s.createDataFrame([(i, int(k), got.attrs["units"]["n_nationkey"]) for i, k in enumerate(got["n_nationkey"])], "rid bigint, key bigint, units string")


@query("SELECT r_regionkey::BIGINT AS rid, (i - 1)::INT AS i, r_regionkey * 0.5::DOUBLE + (i - 1) * 2.0::DOUBLE AS time, (r_regionkey + i)::DOUBLE AS value FROM region, unnest(range(1, 4)) u(i)")
def waveform_view(s, d):
    k = F.col("r_regionkey").cast("double")
    df = waveform.add_waveform(table(s, d, "region").select("r_regionkey"), "wf", F.array(k + 1, k + 2, k + 3), k * 0.5, 2.0, "ns", "ns")
    t = interop.from_arrow(s, interop.view_as(Table.of(df, "r_regionkey"), "arrow", ["wf"]))
    return waveform.samples(t.df, "wf", [RID]).withColumnRenamed(RID, "rid")


@query("SELECT unnest(['same', 'value', 'attrs', 'rows']) AS change, unnest([true, false, false, false]) AS equal, (SELECT count(*) FROM nation)::BIGINT AS n")
def tables_equal(s, d):
    t = _nations(s, d)
    others = {"same": _nations(s, d), "value": t.assign("n_name", [3], "x"), "attrs": t.setattrs("n_name", units="m"), "rows": t.resize(10)}
    return s.createDataFrame([(k, t.equals(o), len(t)) for k, o in others.items()], "change string, equal boolean, n bigint")


@query("SELECT unnest(['n_regionkey', 'k']) AS name, unnest([1, 2])::INT AS ndim, unnest(['bigint', 'bigint']) AS dtype, (SELECT count(DISTINCT n_regionkey) FROM nation)::BIGINT AS n")
def column_dimensions(s, d):
    t = _by_region(s, d)
    return s.createDataFrame([(c, t.ndim(c), t.dtype(c), t.shape(c)[0]) for c in t], "name string, ndim int, dtype string, n bigint")
