"""Encoded arrays: bytes (or small integers) with the size each has once decoded. Codecs aren't part of it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raggedlake.operators.table import Table
from raggedlake.schema import KIND, RID


def encoded(data: Column, decoded_size: Column) -> Column:
    """struct<encoded_data, decoded_size>."""
    return F.struct(data.alias("encoded_data"), decoded_size.cast("int").alias("decoded_size"))


def add_encoded(df: DataFrame, name: str, data: Column, decoded_size: Column | int, codec: str | None = None) -> DataFrame:
    """Add an encoded column. A number as decoded_size holds for every row and is kept as metadata."""
    meta = {"codec": codec} if codec else {}
    if isinstance(decoded_size, int) and decoded_size < 0:
        raise ValueError("a decoded size is 0 or more")
    if isinstance(decoded_size, int):
        return df.withColumn(name, data).withMetadata(name, {KIND: "encoded_equalsized", "decoded_size": decoded_size, **meta})
    return df.withColumn(name, encoded(data, decoded_size)).withMetadata(name, {KIND: "encoded", **meta})


def as_rows(df: DataFrame, name: str) -> Column:
    """struct<encoded_data, decoded_size> of either kind: a common size becomes a column."""
    f = df.schema[name]
    if f.metadata.get(KIND) == "encoded_equalsized":
        return encoded(F.col(f"`{name}`"), F.lit(f.metadata["decoded_size"]))
    return F.col(f"`{name}`")


def sizes(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Encoded and decoded size of each row."""
    row = as_rows(df, name)
    binary = df.schema[name].dataType.simpleString() == "binary" or "encoded_data:binary" in df.schema[name].dataType.simpleString()
    size = F.octet_length if binary else F.size
    return df.select(*(keep or []), size(row["encoded_data"]).cast("bigint").alias("encoded_size"), row["decoded_size"].cast("bigint").alias("decoded_size"))


def get(table: Table, name: str, i: int) -> tuple[bytes | list, int]:
    """The encoded data of a row and its decoded size."""
    at = table._index(i)
    got = table.df.where(F.col(RID) == at).select(as_rows(table.df, name).alias("r")).head(1)
    if not got:
        raise IndexError(i)
    data = got[0].r["encoded_data"]
    return bytes(data) if isinstance(data, (bytes, bytearray)) else data, got[0].r["decoded_size"]


def iterate(table: Table, name: str) -> Iterator[tuple[bytes | list, int]]:
    """(encoded data, decoded size) of each row in order, a partition at a time."""
    for r in table.df.orderBy(RID).select(as_rows(table.df, name).alias("r")).toLocalIterator():
        yield (bytes(r.r["encoded_data"]) if isinstance(r.r["encoded_data"], (bytes, bytearray)) else r.r["encoded_data"]), r.r["decoded_size"]


def set_row(table: Table, name: str, i: int, data: bytes, decoded_size: int | None = None) -> Table:
    """Other contents in row i; a column with a common decoded size takes only rows of that size."""
    f = table.df.schema[name]
    common = f.metadata.get("decoded_size") if f.metadata.get(KIND) == "encoded_equalsized" else None
    if common is not None:
        if decoded_size not in (None, common):
            raise ValueError(f"all rows decode to {common} elements, not {decoded_size}")
        return table.assign(name, [i], data)
    if decoded_size is None:
        raise ValueError("the decoded size is needed")
    at = F.col(RID) == table._index(i)
    return table.add(name, replaced(name, at, F.lit(data).cast(f.dataType["encoded_data"].dataType), F.lit(decoded_size)))


def insert_row(table: Table, name: str, i: int, data: bytes, decoded_size: int) -> Table:
    """A row more in a table that has just the encoded column."""
    return table.insert(i, {name: {"encoded_data": data, "decoded_size": decoded_size}})


def replaced(name: str, at: Column, data: Column, decoded_size: Column) -> Column:
    """The encoded column with other contents where `at` is true."""
    return F.when(at, encoded(data, decoded_size)).otherwise(F.col(f"`{name}`"))
