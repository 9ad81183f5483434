"""Waveforms: struct<t0, dt, values>, sampled at t0 + i * dt; units are metadata of the fields."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raggedlake.operators.table import Table
from raggedlake.schema import KIND, RID, with_attrs

FIELDS = ("t0", "dt", "values")


def waveform(values: Column, t0: Column | float = 0.0, dt: Column | float = 1.0) -> Column:
    """One column of waveforms; numbers for t0 and dt hold for every row."""
    one = lambda x: (x if isinstance(x, Column) else F.lit(float(x))).cast("float")
    return F.struct(one(t0).alias("t0"), one(dt).alias("dt"), values.alias("values"))


def add_waveform(df: DataFrame, name: str, values: Column, t0: Column | float = 0.0, dt: Column | float = 1.0, t0_units: str | None = None, dt_units: str | None = None, values_units: str | None = None, wf_len: int | None = None) -> DataFrame:
    """Add a waveform column. wf_len: all have this length (shorter ones get zeros); None: each its own."""
    out = df.withColumn(name, waveform(values if wf_len is None else resized(values, wf_len), t0, dt))
    out = out.withMetadata(name, {KIND: "waveform"} | ({"shape": [wf_len]} if wf_len is not None else {}))
    for part, units in zip(FIELDS, (t0_units, dt_units, values_units)):
        if units:
            out = with_attrs(out, f"{name}/{part}", {"units": units})
    return out


def zeros(spark: SparkSession, size: int = 1024, wf_len: int | None = None, name: str = "waveform", **units: str) -> Table:
    """A table of waveforms of zeros (t0 0, dt 1), empty ones without wf_len."""
    values = F.array_repeat(F.lit(0.0), wf_len or 0)
    return Table(add_waveform(spark.range(size).select(F.col("id").alias(RID)), name, values, wf_len=wf_len, **units))


def resized(values: Column, length: int) -> Column:
    """Every array cut or filled with zeros to this length, each row for itself."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0), length)), 1, length)


def set_length(df: DataFrame, name: str, length: int) -> DataFrame:
    meta = df.schema[name].metadata
    return df.withColumn(name, F.col(f"`{name}`").withField("values", resized(F.col(f"`{name}`.values"), length))).withMetadata(name, {**meta, "shape": [length]})


def length_of(df: DataFrame, name: str) -> int:
    """The common length, or -1 if each waveform has its own."""
    shape = df.schema[name].metadata.get("shape")
    return shape[-1] if shape else -1


def units(df: DataFrame, name: str) -> dict[str, Any]:
    return {f.name: f.metadata.get("units") for f in df.schema[name].dataType.fields}


def set_units(df: DataFrame, name: str, given: Mapping[str, str]) -> DataFrame:
    for part, u in given.items():
        df = with_attrs(df, f"{name}/{part}", {"units": u})
    return df


def samples(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """One row per sample: the columns keep, its number i, time t0 + i * dt and value."""
    w = F.col(f"`{name}`")
    rows = df.select(*(keep or []), w["t0"].cast("double").alias("_t0"), w["dt"].cast("double").alias("_dt"), F.posexplode(w["values"]).alias("i", "value"))
    return rows.select(*(keep or []), "i", (F.col("_t0") + F.col("i") * F.col("_dt")).alias("time"), "value")
