import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raggedlake.operators import encoded, jagged, waveform
from raggedlake.operators.table import Table
from raggedlake.schema import RID, check_plain, datatype, element_type, same_datatype, spark_type
from raggedlake.sources.interop import from_columns

DATA = [[1, 2], [3, 4, 5], [2], [4, 8, 9, 7], [5, 3, 1]]


@pytest.fixture(scope="module")
def vov(spark):
    return from_columns(spark, {"v": DATA})


def col(t, name=None):
    df = t.df if isinstance(t, Table) else t
    return [r[0] for r in df.orderBy(RID).select(name or [c for c in df.columns if c != RID][0]).collect()]


def test_layout(spark, vov):
    assert col(jagged.cumulative_lengths(vov, "v"), "cl") == [2, 5, 6, 10, 13]
    assert vov.datatype_of("v") == "array<1>{array<1>{real}}"
    flat = from_columns(spark, {"x": [x for r in DATA for x in r]})
    assert col(jagged.from_lengths(flat, from_columns(spark, {"cl": [2, 5, 6, 10, 13]}))) == DATA
    assert col(jagged.from_offsets(flat, from_columns(spark, {"o": [0, 2, 5, 6, 10, 13]}))) == DATA
    assert col(jagged.from_lengths(flat, from_columns(spark, {"cl": [0, 2, 2, 13]})))[:3] == [[], [1, 2], []]


def test_selection_and_editing(vov):
    assert col(vov[1::2]) == col(vov[[1, 3]]) == col(vov[[False, True, False, True, False]]) == [[3, 4, 5], [4, 8, 9, 7]]
    assert col(vov.insert(2, {"v": [0, 0, 0]}))[2] == [0, 0, 0]
    assert col(vov.replace(1, {"v": [1]}))[1] == [1]
    assert col(vov.resize(3).resize(5)) == [[1, 2], [3, 4, 5], [2], [], []]
    assert col(jagged.set_from(vov, "v", 2, [[7, 7], [8]], [2, 3])) == [[1, 2], [3, 4, 5], [7, 7], [8, -(2**63), -(2**63)]]
    assert col(jagged.set_from(vov, "v", 0, [[8]], [2], unsigned=True)) == [[8, 0]]


def test_padding(vov):
    got = col(jagged.pad(vov.df, "v"), "v")
    assert got[1][:3] == [3.0, 4.0, 5.0] and math.isnan(got[1][3])
    assert col(jagged.pad(vov.df, "v", 4, -999), "v")[0] == [1, 2, -999, -999]
    assert col(jagged.pad(vov.df, "v", 2, -999.9), "v")[2] == [2.0, -999.9]
    assert col(jagged.pad(vov.df, "v", 1, 0, preserve_type=True), "v") == [[1], [3], [2], [4], [5]]


def test_equal_sized(spark):
    t = from_columns(spark, {"v": np.array([[53, 91, 66, 58, 8], [78, 57, 66, 88, 73], [85, 99, 86, 68, 53]])})
    assert t.datatype_of("v") == "array_of_equalsized_arrays<1,1>{real}"
    assert col(jagged.cut_by_cumulative(t, "v", from_columns(spark, {"cl": [2, 5, 6]}))) == [[53, 91], [78, 57, 66], [85]]
    assert jagged.cut(t.df, "v").schema["v"].metadata == {}


def test_kernels(spark):
    t = from_columns(spark, {"n": [3, 1, 0], "x": [5, 7, 9]})
    assert [r["row"] for r in jagged.explode_lengths(t, "n").orderBy("row", "pos").collect()] == [0, 0, 0, 1]
    assert [r["x"] for r in jagged.explode_columns(t.df, "n", ["x"]).orderBy("x", "pos").collect()] == [5, 5, 5, 7]
    runs = jagged.run_lengths(from_columns(spark, {"v": [5, 5, 5, 7, 5]}), "v").df.orderBy(RID).collect()
    assert [(r["value"], r["length"], r["cl"]) for r in runs] == [(5, 3, 3), (7, 1, 4), (5, 1, 5)]
    assert jagged.run_lengths(Table.empty(spark, "v long"), "v").df.count() == 0
    fill = from_columns(spark, {"v": [[1, 2, 3], [4, 5, 6]], "n": [4, 3]})
    assert col(fill.df.select(RID, jagged.fill_beyond(F.col("v"), F.col("n"), T.LongType(), True).alias("f"))) == [[1, 2, 3, 0], [4, 5, 6]]
    with pytest.raises(ValueError):
        check_plain(T.ArrayType(T.StructType([T.StructField("a", T.LongType())])))


def test_waveforms(spark):
    base = spark.createDataFrame([(0, 0.0, [0.0, 1.0, 2.0]), (1, 0.5, [5.0])], "_rid long, start double, v array<float>")
    df = waveform.add_waveform(base, "wf", F.col("v"), F.col("start"), 16.0, "us", "ns", "mV")
    assert waveform.units(df, "wf") == {"t0": "us", "dt": "ns", "values": "mV"} and waveform.length_of(df, "wf") == -1
    assert [r["time"] for r in waveform.samples(df, "wf", [RID]).orderBy(RID, "i").collect()] == [0.0, 16.0, 32.0, 0.5]
    fixed = waveform.set_length(df, "wf", 2)
    assert [list(r[0]["values"]) for r in fixed.orderBy(RID).select("wf").collect()] == [[0.0, 1.0], [5.0, 0.0]] and waveform.length_of(fixed, "wf") == 2
    assert len(waveform.zeros(spark, 10, 1000)) == 10
    assert waveform.zeros(spark, 1, 3).df.first()["waveform"]["values"] == [0.0, 0.0, 0.0]


def test_encoded(spark):
    t = from_columns(spark, {"d": [b"ab", b"cde"], "n": [6, 7]})
    df = encoded.add_encoded(t.df, "e", F.col("d"), F.col("n"), "zlib")
    assert [tuple(r) for r in encoded.sizes(df, "e", [RID]).orderBy(RID).collect()] == [(0, 2, 6), (1, 3, 7)]
    common = encoded.add_encoded(t.df, "e", F.col("d"), 99)
    assert [r["decoded_size"] for r in encoded.sizes(common, "e").collect()] == [99, 99]
    assert datatype(df.schema["e"].dataType, df.schema["e"].metadata) == "array<1>{encoded_array<1>{real}}"
    new = df.withColumn("e", encoded.replaced("e", F.col(RID) == 1, F.lit(b"z"), F.lit(3)))
    assert bytes(new.orderBy(RID).collect()[1]["e"]["encoded_data"]) == b"z"


def test_element_types():
    assert [element_type(x) for x in ("hi", True, np.void(0), np.uint8(1), 1.5, 1j, b"a")] == ["string", "bool", "blob", "real", "real", "complex", "string"]
    with pytest.raises(ValueError):
        element_type(np.datetime64("2020-01-01"))
    assert spark_type("uint32") == T.LongType() and same_datatype("table{a,b}", "table{b,a}") and not same_datatype("table{a}", "struct{a}")
