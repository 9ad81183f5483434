"""Wrong positions, constants in expressions, integers beyond double precision, views and their errors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raggedlake.functions.expr import ExpressionError
from raggedlake.operators import encoded, jagged
from raggedlake.operators.histogram import Axis, Histogram
from raggedlake.operators.table import Struct, Table
from raggedlake.plans.session import drop_materialized, materialize, scratch, shared_dir
from raggedlake.schema import KIND, RID
from raggedlake.sources import interop


@pytest.fixture(scope="module")
def t(spark):
    return interop.from_columns(spark, {"a": [7, -7, 3], "w": np.arange(9).reshape(3, 3), "v": [[1], [], [2, 3]]})


def values(table, name="value"):
    return [r[0] for r in table.df.orderBy(RID).select(name).collect()]


def test_positions_beyond_the_end(t):
    for wrong in ([0, 7], [True, False], [-4]):
        with pytest.raises(IndexError):
            t[wrong]
    assert values(t[[2, -3]], "a") == [3, 7] and values(t[[True, False, True]], "a") == [7, 3]


def test_counts_are_carried(t):
    assert [len(x) for x in (t[1:], t[::-1], t[[0, 0]], t.resize(5), t.clear(), t.append({"a": 1, "w": [0, 0, 0], "v": []}), t.remove("v"), t.where("a > 0"))] == [2, 3, 2, 5, 0, 4, 3, 2]
    assert t[1:]._count == 2


def test_constants(t):
    assert t.eval("np.sum(a) * -1").value == -3 and t.eval("-(2 + 3) * 2").value == -10
    assert values(t.eval("w * -1")) == [[0, -1, -2], [-3, -4, -5], [-6, -7, -8]]
    assert values(t.eval("w * (1 + 1)"))[1] == [6, 8, 10] and values(t.eval("w * np.sqrt(4.0)"))[1] == [6.0, 8.0, 10.0]
    assert values(t.eval("w + a"))[0] == [7, -6, 5]  # a is aligned with the last axis
    with pytest.raises(ExpressionError):
        t.eval("len(a)")
    with pytest.raises(ValueError):
        t.eval("a", library="other")


def test_exact_integers(spark):
    big = interop.from_columns(spark, {"x": [94906267, -3, 0, 1], "n": [2, 3, 0, 90], "y": [10, -10, 3, 7]})
    assert values(big.eval("x**2")) == [94906267**2, 9, 0, 1]
    assert values(big.eval("x**n")) == [94906267**2, -27, 1, 1]
    assert values(big.eval("9223372036854775807 // y")) == [9223372036854775807 // k for k in (10, -10, 3, 7)]
    assert values(big.eval("x // y")) == [94906267 // 10, 0, 0, 0] and values(big.eval("x % y")) == [7, -3, 0, 1]
    with pytest.raises(Exception, match="OVERFLOW"):
        values(big.eval("x**5"))
    with pytest.raises(Exception, match="negative integer powers"):
        values(interop.from_columns(spark, {"x": [2], "n": [-1]}).eval("x**n"))


def test_runs_across_blocks(spark):
    rows = [1, 1, 1, None, None, 2, 2, 1, 1, 1]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"{RID} bigint, v int").repartition(3)
    for block in (1, 2, 3, 100):
        got = [(r["value"], r["length"], r["cl"]) for r in jagged.run_lengths(Table(df), "v", block).df.orderBy(RID).collect()]
        assert got == [(1, 3, 3), (None, 2, 5), (2, 2, 7), (1, 3, 10)]


def test_views(spark, t):
    u = t.setattrs("a", units="m").setattrs("v", units="s")
    assert u.shape("w") == (3, 3) and u.shape("v") == (3, None) and u.ndim("v") == 2 and list(u) == u.keys() and len(u.values()) == 3
    assert interop.view_as(u, "np", ["w"]).tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    assert sorted(interop.view_as(u, "np", ["a", "w"])) == ["a", "w"]
    assert interop.view_as(u, "arrow", ["v"])["v"].to_pylist() == [[1], [], [2, 3]]
    for library, cols in (("np", ["a"]), ("pd", ["v"])):
        with pytest.raises(ValueError):
            interop.view_as(u, library, cols, with_units=True)
    with pytest.raises(ValueError):
        interop.view_as(u, "other")
    with pytest.raises(NotImplementedError):
        Struct({"a": 1}).view_as("pd")
    with pytest.warns(UserWarning, match="2 chunks"):
        assert values(interop.from_arrow(spark, pa.chunked_array([[1], [2]]))) == [1, 2]


def test_records_in_arrays_are_refused(spark):
    df = spark.range(2).select(F.col("id").alias(RID), F.array(F.struct(F.col("id").alias("x"))).alias("r"))
    with pytest.raises(ValueError, match="arrays of"):
        Table(df)


def test_encoded_editing(spark):
    base = interop.from_columns(spark, {"k": [b"ab", b"c"]})
    e = Table(encoded.add_encoded(base.df, "e", F.col("k"), F.lit(4)).select(RID, "e"))
    e = encoded.insert_row(encoded.set_row(e, "e", 1, b"xyz", 9), "e", 0, b"", 0)
    assert list(encoded.iterate(e, "e")) == [(b"", 0), (b"ab", 4), (b"xyz", 9)] and encoded.get(e, "e", -1) == (b"xyz", 9)
    frame = interop.to_pandas(e)
    assert list(frame.columns) == ["e"] or frame.shape[1] == 2
    same = Table(encoded.add_encoded(base.df, "e", F.col("k"), 4).select(RID, "e"))
    assert encoded.get(encoded.set_row(same, "e", 0, b"q"), "e", 0) == (b"q", 4)
    with pytest.raises(ValueError):
        encoded.set_row(same, "e", 0, b"q", 5)
    with pytest.raises(IndexError):
        encoded.get(same, "e", 9)
    assert same.df.schema["e"].metadata[KIND] == "encoded_equalsized"


def test_histogram_of_arrays(spark):
    data = np.array([[0.5, 1.5], [1.5, 0.5], [9.0, 0.0]])
    two = Histogram.make([(0, 2, 1), (0, 2, 1)], spark=spark)
    for rows in (data, [data[:, 0], data[:, 1]]):
        assert two.fill(rows).weights.tolist() == [[0, 1], [1, 0]]
    assert two.fill({"x": data[:, 0], "y": data[:, 1], "z": [1]}, ["y", "x"]).weights.tolist() == [[0, 1], [1, 0]]
    with pytest.raises(ValueError):
        two.fill([data[:, 0], data[:2, 1]])
    with pytest.raises(ValueError):
        two.fill(data[:, 0])

    class Axes:
        edges = [0.0, 1.0, 3.0]

    class Other:
        axes = (Axes(),)

        def values(self):
            return np.array([4.0, 5.0])

    h = Histogram.from_hist(Other(), spark)
    assert h.weights.tolist() == [4, 5] and h.axes[0].nbins == 2
    with pytest.raises(ValueError):
        Histogram.make([Axis(first=0, last=1, step=1, closedleft=False)], spark=spark).view_as("hist")


def test_scratch_is_cleaned(spark):
    import os

    folder = shared_dir(spark).removeprefix("file://")
    found = lambda: sorted(f for d, _, _ in os.walk(folder) for f in [d] if "mark-" in f)
    with scratch(spark):
        assert materialize(spark.range(3).toDF("x"), "mark").count() == 3 and found()
    assert not found()
    df = materialize(spark.range(3).toDF("x"), "mark")
    drop_materialized(df)
    assert not found()
