"""Arrays of differing length: building, exploding, padding, run lengths and editing."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raggedlake.operators.table import Table
from raggedlake.schema import KIND, RID, depth, innermost

_INT_MIN = {"tinyint": -(2**7), "smallint": -(2**15), "int": -(2**31), "bigint": -(2**63)}


def sentinel(kind: T.DataType, unsigned: bool = False) -> Column:
    """What stands for a missing element: NaN, or the type's least integer (0 for an unsigned one)."""
    name = kind.simpleString()
    if name in ("float", "double"):
        return F.lit(float("nan")).cast(kind)
    if name in _INT_MIN:
        return F.lit(0 if unsigned else _INT_MIN[name]).cast(kind)
    raise ValueError(f"no sentinel for {name}")


def build(df: DataFrame, keys: list[str], order_by: list[str], value: str, name: str = "values") -> DataFrame:
    """One array of value per key, elements in the order of order_by (then of value).

    Rows are gathered once per key after a shuffle on the keys; a key's array has to fit a row, as arrays do.
    """
    pairs = F.array_sort(F.collect_list(F.struct(*order_by, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["_v"]).alias(name))


def from_lengths(flat: Table, lengths: Table, name: str = "values") -> Table:
    """Arrays from a flat column and a column of cumulative lengths: row r has the elements cl[r-1] .. cl[r]-1.

    Each element finds its row by equality on a block of positions, not by comparing all bounds.
    """
    v, cl = flat.columns[0], lengths.columns[0]
    block = 4096
    lens = _with_previous(lengths.df.select(RID, F.col(f"`{cl}`").cast("bigint").alias("stop")), "stop", "start")
    spans = lens.where("stop > start").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    items = flat.df.select(F.col(RID).alias("pos"), F.col(f"`{v}`").alias("v")).withColumn("_b", F.floor(F.col("pos") / block))
    hit = items.join(spans, "_b").where("pos >= start and pos < stop")
    rows = hit.groupBy(RID).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias(name))
    kind = T.ArrayType(flat.df.schema[v].dataType)
    return Table(lengths.df.select(RID).join(rows, RID, "left").withColumn(name, F.coalesce(name, F.array().cast(kind))))


def from_offsets(flat: Table, offsets: Table, name: str = "values") -> Table:
    """As from_lengths, with n + 1 offsets of which the first is 0."""
    c = offsets.columns[0]
    rest = offsets.df.where(F.col(RID) > 0).select((F.col(RID) - 1).alias(RID), F.col(f"`{c}`").alias("cl"))
    return from_lengths(flat, Table(rest), name)


def _with_previous(df: DataFrame, column: str, name: str) -> DataFrame:
    """The value at the position before (0 at the first), by an equality join on positions."""
    before = df.select((F.col(RID) + 1).alias(RID), F.col(column).alias(name))
    return df.join(before, RID, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def running_sum(df: DataFrame, value: Column, name: str, block: int = 65_536) -> DataFrame:
    """Cumulative sum over positions: sums of blocks of positions first, then inside each block."""
    rows = df.withColumn("_b", F.floor(F.col(RID) / block)).withColumn("_x", value)
    blocks = rows.groupBy("_b").agg(F.sum("_x").alias("_s"))
    # one row per block of rows; a second level of blocks keeps the last window small
    blocks = blocks.withColumn("_bb", F.floor(F.col("_b") / block))
    tops = blocks.groupBy("_bb").agg(F.sum("_s").alias("_t")).withColumn("_before_t", F.sum("_t").over(Window.orderBy("_bb")) - F.col("_t")).drop("_t")
    inside = F.sum("_s").over(Window.partitionBy("_bb").orderBy("_b")) - F.col("_s")
    before = blocks.join(tops, "_bb").select("_b", (inside + F.col("_before_t")).alias("_before"))
    within = F.sum("_x").over(Window.partitionBy("_b").orderBy(RID))
    return rows.join(before, "_b").withColumn(name, within + F.col("_before")).drop("_b", "_x", "_before")


def lengths(table: Table, name: str) -> Table:
    return Table(table.df.select(RID, F.size(f"`{name}`").cast("bigint").alias("length")))


def cumulative_lengths(table: Table, name: str) -> Table:
    """The running sum of an array column's lengths."""
    return Table(running_sum(table.df.select(RID, f"`{name}`"), F.size(f"`{name}`").cast("bigint"), "cl").select(RID, "cl"))


def flattened(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """One row per element: the columns keep, its position pos in the array, and value."""
    return df.select(*(keep or []), F.posexplode(f"`{name}`").alias("pos", "value"))


def run_lengths(table: Table, name: str, block: int = 65_536) -> Table:
    """Lengths and cumulative lengths of runs of equal neighbours; no rows give no runs.

    Neighbours are compared inside blocks of positions, in one shuffle; only a block's last row (one in `block`) goes to the next one.
    """
    v = F.col("v")
    rows = table.df.select(RID, F.col(f"`{name}`").alias("v")).withColumn("_b", F.floor(F.col(RID) / block))
    edges = rows.groupBy("_b").agg(F.max_by("v", RID).alias("_edge")).select((F.col("_b") + 1).alias("_b"), "_edge", F.lit(True).alias("_has"))
    inside = rows.withColumn("_before", F.lag(F.struct("v")).over(Window.partitionBy("_b").orderBy(RID)))
    starts = F.when(F.col("_before").isNotNull(), ~v.eqNullSafe(F.col("_before.v"))).when(F.col("_has"), ~v.eqNullSafe(F.col("_edge"))).otherwise(F.lit(True))
    marked = inside.join(edges, "_b", "left").withColumn("_new", starts.cast("bigint")).select(RID, "v", "_new")
    runs = running_sum(marked, F.col("_new"), "_run", block).groupBy((F.col("_run") - 1).alias(RID)).agg(F.first("v").alias("value"), F.count(F.lit(1)).alias("length"), (F.max(F.col(RID)) + 1).alias("cl"))
    return Table(runs)


def explode_lengths(table: Table, name: str) -> DataFrame:
    """The row's position as often as a column of lengths says; rows of length 0 vanish."""
    return table.df.where(F.col(f"`{name}`") > 0).select(F.col(RID).alias("row"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"`{name}`").cast("bigint") - 1)).alias("pos"))


def explode_columns(df: DataFrame, length: str, columns: list[str]) -> DataFrame:
    """Each row's columns as often as length says, with pos counting the copies."""
    return df.where(F.col(f"`{length}`") > 0).select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"`{length}`").cast("bigint") - 1)).alias("pos"))


def widest(df: DataFrame, name: str) -> int:
    return df.agg(F.max(F.size(f"`{name}`"))).first()[0] or 0


def pad(df: DataFrame, name: str, width: int | None = None, fill: Any = None, preserve_type: bool = False) -> DataFrame:
    """Arrays of one width: longer ones cut, shorter ones filled (NaN unless fill is given).

    Elements become double (bigint if fill is an integer and they are), or keep their type with preserve_type.
    """
    width = widest(df, name) if width is None else width
    kind = innermost(df.schema[name].dataType)
    if depth(df.schema[name].dataType) != 1:
        raise ValueError("only arrays of one level can be padded")
    if preserve_type:
        to = kind
    else:
        to = T.LongType() if isinstance(fill, int) and isinstance(kind, T.IntegralType) else T.DoubleType()
    value = F.lit(float("nan") if fill is None else fill).cast(to)
    col = F.slice(F.concat(F.transform(f"`{name}`", lambda x: x.cast(to)), F.array_repeat(value, width)), 1, width)
    return df.withColumn(name, col).withMetadata(name, {**df.schema[name].metadata, KIND: "equalsized", "shape": [width]})


def cut(df: DataFrame, name: str, length: Column | None = None) -> DataFrame:
    """Arrays of one width to arrays of their own lengths: the first `length` elements, or all."""
    meta = {k: v for k, v in df.schema[name].metadata.items() if k not in (KIND, "shape")}
    col = F.col(f"`{name}`") if length is None else F.slice(f"`{name}`", F.lit(1), length.cast("int"))
    return df.withColumn(name, col).withMetadata(name, meta)


def cut_by_cumulative(table: Table, name: str, cumulative: Table) -> Table:
    """As cut(), with the lengths' running sum given by position."""
    c = cumulative.columns[0]
    spans = _with_previous(cumulative.df.select(RID, F.col(f"`{c}`").cast("bigint").alias("_stop")), "_stop", "_start")
    df = table.df.join(spans, RID)
    return Table(cut(df, name, F.col("_stop") - F.col("_start")).drop("_stop", "_start"), table.attrs)


def fill_beyond(values: Column, length: Column, kind: T.DataType, unsigned: bool = False) -> Column:
    """The first `length` elements, sentinels standing for those beyond the array's width."""
    n = length.cast("int")
    return F.slice(F.concat(values, F.array_repeat(sentinel(kind, unsigned), F.greatest(n, F.lit(0)))), F.lit(1), n)


def set_from(table: Table, name: str, at: int, rows: list[list], lens: list[int] | None = None, unsigned: bool = False) -> Table:
    """Write arrays from position at on and drop what came after; a length beyond its row's width gives sentinels."""
    kind = table.df.schema[name].dataType
    lens = [len(r) for r in rows] if lens is None else lens
    new = table.spark.createDataFrame([(at + i, r, n) for i, (r, n) in enumerate(zip(rows, lens))], T.StructType([T.StructField(RID, T.LongType()), T.StructField(name, kind), T.StructField("_n", T.IntegerType())]))
    new = new.select(RID, fill_beyond(F.col(name), F.col("_n"), kind.elementType, unsigned).alias(name))
    return Table(table.df.where(F.col(RID) < at).select(RID, name).unionByName(new), table.attrs)
