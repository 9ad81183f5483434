import numpy as np
import pytest

from raggedlake.operators.histogram import Axis, Histogram
from raggedlake.streaming.histograms import accumulate, total


def weights(spark, h):
    return h.to_numpy(spark)[0].tolist()


def xs(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_fill(spark):
    for axis, second in (((0, 5, 1), [2, 2, 0, 2, 1]), ([0, 0.75, 2, 4, 4.5, 5], [2, 2, 2, 1, 0])):
        h = Histogram.make([axis]).fill(xs(spark, [0.5, 1.5, 1.1]))
        assert weights(spark, h) == [1, 2, 0, 0, 0]
        h = h.fill(xs(spark, [0.5, 3.5, 4.0, 3.5]))
        assert weights(spark, h) == second
        assert weights(spark, h.fill(xs(spark, [-1, 6, float("inf"), float("nan")]))) == second
        assert h.dense(spark).count() == 5


def test_closure(spark):
    data = xs(spark, [0, 2, 4, 6])
    assert weights(spark, Histogram.make([Axis(first=0, last=6, step=1)]).fill(data)) == [1, 0, 1, 0, 1, 0]
    assert weights(spark, Histogram.make([Axis(first=0, last=6, step=1, closedleft=False)]).fill(data)) == [0, 1, 0, 1, 0, 1]
    edges = [0, 0.75, 2, 4, 4.5, 5, 6]
    assert weights(spark, Histogram.make([Axis.from_edges(edges)]).fill(data)) == [1, 0, 1, 1, 0, 0]
    assert weights(spark, Histogram.make([Axis.from_edges(edges, closedleft=False)]).fill(data)) == [0, 1, 1, 0, 0, 1]
    inner = Histogram.make([Axis(first=0, last=3, step=1, closedleft=False)]).fill(xs(spark, [0.5, 1.5, 2.5]))
    assert weights(spark, inner) == [1, 1, 1]


def test_last_bin_keeps_values_just_below_the_edge(spark):
    h = Histogram.make([Axis(first=0, last=1, step=1 / 3)]).fill(xs(spark, [np.nextafter(1, 0)]))
    assert weights(spark, h) == [0, 0, 1]


def test_two_dimensions_and_weights(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (2, 2, 3.0), (-1, 2, 1.0), (2, -1, 1.0)], "a long, b long, w double")
    h = Histogram.make([(0, 3, 1), (0, 3, 1)])
    assert weights(spark, h.fill(df, ["a", "b"])) == [[0, 0, 0], [0, 1, 0], [0, 0, 1]]
    assert weights(spark, h.fill(df, ["a", "b"], "w")) == [[0, 0, 0], [0, 2, 0], [0, 0, 3]]
    with pytest.raises(ValueError):
        h.fill(df, ["a"])


def test_axes(spark):
    assert Axis(first=0, last=1, step=0.1).nbins == 10 and Axis.from_range_edges([0, 1, 2]).is_range
    for bad in (dict(), dict(edges=(1, 0)), dict(edges=(0, 1), first=0), dict(first=1, last=0, step=1)):
        with pytest.raises(ValueError):
            Axis(**bad)
    with pytest.raises(ValueError):
        Axis.from_range_edges([0, 1, 3])
    h = Histogram.make([[0, 1, 2]], np.array([3.0, 4.0]), spark)
    assert weights(spark, h) == [3, 4] and h.shape == (2,)
    with pytest.raises(ValueError):
        Histogram.make([[0, 1, 2]], np.array([3.0]), spark)
    many = Histogram.make([[i / 4 for i in range(201)]]).fill(xs(spark, [0, 0.26, 49.99, 50]))
    assert many.counts.count() == 3


def test_more_than_ten_axes_keep_their_order(spark):
    h = Histogram.make([(0, 2, 1)] * 12)
    df = spark.createDataFrame([tuple([0] * 11 + [1])], ", ".join(f"c{i} long" for i in range(12)))
    assert h.fill(df).counts.first()["bin_11"] == 1


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    xs(spark, [0.5, 1.5, 1.1]).write.parquet(src)
    h = Histogram.make([(0, 5, 1)])
    out = "file://" + str(tmp_path / "out")
    for more in ([], [3.5, 4.0]):
        if more:
            xs(spark, more).write.mode("append").parquet(src)
        accumulate(spark.readStream.schema("x double").parquet(src), h, ["x"], out, "file://" + str(tmp_path / "cp")).awaitTermination()
    assert weights(spark, total(spark, h, out)) == [1, 2, 0, 1, 1]
