import pytest
from pyspark.sql import functions as F

from raggedlake.functions.expr import ExpressionError
from raggedlake.operators.table import Scalar, Struct, Table
from raggedlake.sources.interop import from_columns


def rows(t):
    return [tuple(r) for r in t.ordered().collect()]


@pytest.fixture(scope="module")
def flat(spark):
    return from_columns(spark, {"a": [1, 2, 3, 4], "b": [5, 6, 7, 8], "c": [9, 10, 11, 12]}, {"test": "hello, world!"})


@pytest.fixture(scope="module")
def mixed(spark):
    return from_columns(
        spark,
        {"a": [1, 2, 3, 4], "b": [5, 6, 7, 8], "e": [[1, 2, 3], [4], [], [8, 6]], "ee": [[[1], [2, 3]], [[], [4]], [[]], [[8, 6]]], "tbl": {"z": [1, 1, 1, 1], "y": [8, 8, 8, 8]}},
        column_attrs={"a": {"units": "s"}},
    )


def test_selection(flat):
    assert {k: v.value for k, v in flat[1].items()} == {"a": 2, "b": 6, "c": 10}
    assert rows(flat[[1, 2]]) == rows(flat[1:3]) == rows(flat[[False, True, True, False]]) == [(2, 6, 10), (3, 7, 11)]
    assert rows(flat[[2, 0, 2]]) == [(3, 7, 11), (1, 5, 9), (3, 7, 11)]
    assert rows(flat[::-2]) == [(4, 8, 12), (2, 6, 10)]
    assert rows(flat[-2:]) == [(3, 7, 11), (4, 8, 12)]
    assert rows(flat[F.col("a") > 2]["b", "a"]) == [(7, 3), (8, 4)]
    assert rows(flat[[]]) == []
    assert flat[1:3].attrs == {"test": "hello, world!"}
    assert flat[-1]["a"].value == 4
    with pytest.raises(IndexError):
        flat[4]


def test_editing(flat):
    t = flat[["a", "b"]]
    assert rows(t.append({"a": -1, "b": -1}))[-1] == (-1, -1)
    assert [r[0] for r in rows(t.insert(1, {"a": -1, "b": -1}))] == [1, -1, 2, 3, 4]
    assert [r[0] for r in rows(t.insert(0, [{"a": 8, "b": 0}, {"a": 9, "b": 0}]))] == [8, 9, 1, 2, 3, 4]
    assert rows(t.insert(1, [])) == rows(t)
    assert rows(t.insert(2, t[0:2]))[2:4] == [(1, 5), (2, 6)]
    assert rows(t.replace(3, {"a": 0, "b": 1}))[3] == (0, 1)
    assert rows(t.resize(2)) == [(1, 5), (2, 6)]
    assert rows(t.resize(5))[4] == (0, 0)
    assert len(t.clear()) == 0
    assert len(t) == 4
    with pytest.raises(IndexError):
        t.insert(5, {"a": 1, "b": 1})
    with pytest.raises(ValueError):
        t.append({"a": 1})


def test_positional_join(spark):
    t1 = from_columns(spark, {"a": [1, 2, 3, 4], "b": [5, 6, 7, 8], "c": [9, 10, 11, 12]})
    t2 = from_columns(spark, {"b": [13, 14, 15, 16], "d": [17, 18, 19, 20]})
    assert [r["b"] for r in t1.join(t2).ordered().collect()] == [13, 14, 15, 16]
    assert [r["b"] for r in t1.join(t2, keep_mine=True).ordered().collect()] == [5, 6, 7, 8]
    assert t1.join(t2, prefix="tb2_").columns == ["a", "b", "c", "tb2_b", "tb2_d"]
    assert t1.join(t2, suffix="_tb2").columns == ["a", "b", "c", "b_tb2", "d_tb2"]
    assert t1.join(t2, cols="d").columns == ["a", "b", "c", "d"]
    assert [r["d"] for r in t1.join(t2[0:2], cols=["d"]).ordered().collect()] == [17, 18, 0, 0]


def test_nested(spark):
    t = from_columns(spark, {"a": [1, 2], "tbl": {"b": [3, 4], "tbl1": {"z": [9, 9]}}})
    assert t.flatten().columns == ["a", "tbl__b", "tbl__tbl1__z"]
    assert t.datatype == "table{a,tbl}" and t.datatype_of("tbl/tbl1") == "table{z}"
    assert "tbl/tbl1/z" in t and "tbl/none" not in t
    more = t.add("tbl/tbl1/y", F.lit(7)).remove("tbl.b")
    assert more.flatten().columns == ["a", "tbl__tbl1__z", "tbl__tbl1__y"]
    assert t.update({"tbl": {"tbl1": {"z": F.lit(0)}}}).flatten().ordered().first()["tbl__tbl1__z"] == 0
    assert t.setattrs("tbl/b", units="keV").getattrs("tbl/b") == {"units": "keV"}
    with pytest.raises(TypeError):
        t.add("x", [1, 2])


def test_struct_and_scalar():
    s = Struct({"a": Scalar(1), "st": {"x": Scalar(2)}})
    s["st/deep/y"] = Scalar(3)
    assert s["st.deep.y"] == Scalar(3) and s.datatype == "struct{a,st}"
    s.update({"st": {"x": Scalar(5)}})
    assert s.st.x.value == 5 and s["/st/deep/y"].value == 3
    del s["st/deep"]
    assert "deep" not in s["st"]
    assert Scalar(1, {"u": 1}) != Scalar(1)
    with pytest.raises(ValueError):
        Scalar([1])
    with pytest.raises(ValueError):
        Struct({"a": Scalar(1)}, {"datatype": "struct{b}"})
    with pytest.raises(ValueError):
        Scalar(1, {"datatype": "string"})


def value(t, text, **kw):
    r = t.eval(text, **kw)
    return r.value if isinstance(r, Scalar) else [x[0] for x in r.ordered().collect()]


def test_eval(mixed):
    assert value(mixed, "sum(a)") == 10
    assert value(mixed, "a + tbl__z") == [2, 3, 4, 5]
    assert value(mixed, "((a - b) > 1) & ((b - a) < -1)") == [False] * 4
    assert value(mixed, "a**2") == [1, 4, 9, 16]
    assert value(mixed, "a + e") == [[2, 3, 4], [6], [], [12, 10]]
    assert value(mixed, "2*e + 1") == [[3, 5, 7], [9], [], [17, 13]]
    assert value(mixed, "2*ee + 1") == [[[3], [5, 7]], [[], [9]], [[]], [[17, 13]]]
    assert value(mixed, "e > 2") == [[False, False, True], [True], [], [True, True]]
    assert value(mixed, "ak.sum(e, axis=-1)") == [6, 4, 0, 14]
    assert value(mixed, "ak.sum(e)") == 24
    assert value(mixed, "np.sum(a) + ak.sum(e)") == 34
    assert value(mixed, "a - np.sum(a)") == [-9, -8, -7, -6]
    assert value(mixed, "a*args.value", parameters={"args": type("A", (), {"value": 2})}) == [2, 4, 6, 8]
    assert value(mixed, "a*2", parameters={"a": 5}) == 10 or value(mixed, "b*a", parameters={"a": 5}) == [25, 30, 35, 40]
    assert value(mixed, "-7 // b") == [-2, -2, -1, -1]
    assert value(mixed, "(0 - b) % 4") == [3, 2, 1, 0]
    assert value(mixed, "log(a - 1)")[0] == float("-inf")
    assert value(mixed, "1 / (a - 1)")[:2] == [float("inf"), 1.0]
    assert value(mixed, "where(a > 2, a, -1)") == [-1, -1, 3, 4]
    for bad in ("__import__('os')", "a.__class__", "nope", "a and b", "a < b < 3", "lambda: 1"):
        with pytest.raises((ExpressionError, KeyError)):
            mixed.eval(bad)


def test_eval_nan_and_last_axis(spark):
    t = from_columns(spark, {"x": [1.0, float("nan"), 3.0]})
    assert value(t, "x > 2") == [False, False, True] and value(t, "x != x") == [False, True, False]
    import numpy as np

    d = from_columns(spark, {"a": [1, 2], "d": np.array([[10, 20], [30, 40]])})
    assert value(d, "a + d") == [[11, 22], [31, 42]]
    bad = from_columns(spark, {"a": [1, 2, 3], "d": np.array([[10, 20]] * 3)})
    with pytest.raises(ExpressionError):
        bad.eval("a + d")


def test_equality_and_empty(spark, flat):
    assert flat.equals(flat.slice(0, 4)) and not flat.equals(flat[["a", "b"]]) and not flat.equals(flat.replace(0, {"a": 0, "b": 0, "c": 0}))
    e = Table.empty(spark, "a long")
    assert len(e) == 0 and rows(e.append({"a": 1})) == [(1,)]
    assert value(e, "sum(a)") == 0


def test_row_ids(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = Table.of(df, ["g", "k"]).df.orderBy("_rid").collect()
    assert [r["_rid"] for r in got] == list(range(1000))
    assert [(r["g"], r["k"]) for r in got] == sorted((r["g"], r["k"]) for r in got)
