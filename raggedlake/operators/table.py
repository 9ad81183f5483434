"""Tables with row positions: selection, editing, positional joins, flattening and expressions.

A Table wraps a DataFrame whose column _rid numbers the rows 0, 1, 2 ... It is immutable: editing gives a new
Table. Nothing here collects rows; positions are compared, shifted and joined as columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raggedlake import schema as S
from raggedlake.functions.expr import Compiler, flat_fields
from raggedlake.plans.rowid import renumber, with_row_id
from raggedlake.schema import KIND, RID

#: A list of positions or a mask of more rows than this is shuffled, not broadcast.
BROADCAST_ROWS = 100_000


class Scalar:
    """One value with attributes; equal if both are."""

    def __init__(self, value: Any, attrs: Mapping[str, Any] | None = None):
        if isinstance(value, (list, tuple, dict, set, np.ndarray)):
            raise ValueError("a scalar holds one value")
        S.check_datatype(S.element_type(value), attrs)
        self.value, self.attrs = value, {k: v for k, v in (attrs or {}).items() if k != "datatype"}

    @property
    def datatype(self) -> str:
        return S.element_type(self.value)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Scalar) and self.value == other.value and self.attrs == other.attrs

    __hash__ = None

    def __repr__(self) -> str:
        return f"{self.value!r}" + (f" with attrs={self.attrs}" if self.attrs else "")


class Struct(dict):
    """Named members of any kind and length; names are paths, a/b or a.b."""

    def __init__(self, members: Mapping[str, Any] | None = None, attrs: Mapping[str, Any] | None = None):
        super().__init__()
        self.attrs = {k: v for k, v in (attrs or {}).items() if k != "datatype"}
        for k, v in (members or {}).items():
            self[k] = v
        S.check_datatype(self.datatype, attrs)

    @property
    def datatype(self) -> str:
        return S.struct_datatype(list(self.keys()))

    def __getitem__(self, path: str | Sequence[str]) -> Any:
        if not isinstance(path, str):
            return Struct({p: self[p] for p in path}, self.attrs)
        names = S.split_path(path)
        found = super().__getitem__(names[0])
        return found if len(names) == 1 else found["/".join(names[1:])]

    def __setitem__(self, path: str, value: Any) -> None:
        names = S.split_path(path)
        if len(names) == 1:
            super().__setitem__(names[0], Struct(value) if type(value) is dict else value)
        else:
            if names[0] not in self:
                super().__setitem__(names[0], Struct())
            super().__getitem__(names[0])["/".join(names[1:])] = value

    def __delitem__(self, path: str) -> None:
        names = S.split_path(path)
        if len(names) == 1:
            super().__delitem__(names[0])
        else:
            del super().__getitem__(names[0])["/".join(names[1:])]

    def update(self, other: Mapping[str, Any]) -> None:
        """Merge, members of members too."""
        for k, v in other.items():
            mine = self[k] if k in self else None
            if isinstance(mine, Struct) and isinstance(v, Mapping):
                mine.update(v)
            else:
                self[k] = v

    def view_as(self, library: str = "pd", **options: Any) -> Any:
        """Members differ in length, so a struct has no view of its own; view its members."""
        raise NotImplementedError("a struct has no view; view its members")

    def __repr__(self) -> str:
        inner = ", ".join(f"{k}: {v!r}" for k, v in self.items())
        return f"Struct({inner})" + (f" with attrs={self.attrs}" if self.attrs else "")

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_") or name not in self:
            raise AttributeError(name)
        return self[name]


def default_of(kind: T.DataType) -> Column:
    """What a row added by growing holds: zero, empty text, an empty array."""
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BinaryType):
        return F.lit(b"")
    if isinstance(kind, T.StructType):
        return F.struct(*[default_of(f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(None).cast(kind)


def _keep_metadata(new: DataFrame, old: DataFrame) -> DataFrame:
    """Put the attributes of old's columns back on columns of the same name."""
    for f in old.schema.fields:
        if f.metadata and f.name in new.columns and not new.schema[f.name].metadata:
            new = new.withMetadata(f.name, f.metadata)
    return new


class Table:
    def __init__(self, df: DataFrame, attrs: Mapping[str, Any] | None = None):
        if RID not in df.columns:
            raise ValueError("the rows have no positions; use Table.of()")
        self.df = df
        self.attrs = {k: v for k, v in (attrs or {}).items() if k != "datatype"}
        S.check_datatype(self.datatype, attrs)
        for f in self.schema.fields:
            if f.metadata.get(KIND) not in ("encoded", "complex"):
                S.check_plain(f.dataType)
        self._count: int | None = getattr(df, "_raggedlake_count", None)

    @classmethod
    def of(cls, df: DataFrame, order_by: str | Sequence[str], attrs: Mapping[str, Any] | None = None) -> Table:
        """A table of a DataFrame's rows in the order of these columns."""
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        numbered = with_row_id(df, keys)
        out = cls(_keep_metadata(numbered, df), attrs)
        out._count = numbered._raggedlake_count
        return out

    @classmethod
    def empty(cls, spark: SparkSession, fields: T.StructType | str) -> Table:
        return cls(spark.createDataFrame([], fields).withColumn(RID, F.lit(None).cast("bigint")))

    # what it is

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != RID]

    def keys(self) -> list[str]:
        return self.columns

    def items(self) -> list[tuple[str, Column]]:
        return [(c, F.col(f"`{c}`")) for c in self.columns]

    def values(self) -> list[Column]:
        return [c for _, c in self.items()]

    def __iter__(self):
        """The names of the columns; rows() iterates over rows."""
        return iter(self.columns)

    def dtype(self, path: str) -> str:
        """The element type of a column, whatever its arrays."""
        f = S.field_at(self.df.schema, path)
        return f.metadata.get("dtype") or S.innermost(f.dataType).simpleString()

    def ndim(self, path: str) -> int:
        """Dimensions: the rows, and one for each level of arrays."""
        return 1 + S.depth(S.field_at(self.df.schema, path).dataType)

    def shape(self, path: str) -> tuple[int | None, ...]:
        """The rows and the arrays' sizes; None where these differ from row to row."""
        f = S.field_at(self.df.schema, path)
        inner = f.metadata.get("shape") if f.metadata.get(KIND) == "equalsized" else None
        return (len(self), *(inner or [None] * S.depth(f.dataType)))

    def __contains__(self, path: str) -> bool:
        try:
            S.field_at(self.df.schema, path)
        except (KeyError, TypeError):
            return False
        return True

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema.fields if f.name != RID])

    @property
    def datatype(self) -> str:
        return S.datatype(self.schema)

    def datatype_of(self, path: str) -> str:
        f = S.field_at(self.df.schema, path)
        return S.datatype(f.dataType, f.metadata)

    def getattrs(self, path: str | None = None, datatype: bool = False) -> dict[str, Any]:
        if path is not None:
            return S.get_attrs(self.df, path, datatype)
        return dict(self.attrs) | ({"datatype": self.datatype} if datatype else {})

    def setattrs(self, path: str, **attrs: Any) -> Table:
        return self._same(S.with_attrs(self.df, path, attrs))

    def __len__(self) -> int:
        if self._count is None:
            self._count = self.df.count()
        return self._count

    def ordered(self) -> DataFrame:
        """The rows in order, without positions."""
        return self.df.orderBy(RID).drop(RID)

    def rows(self):
        """Iterate over rows in order, a partition at a time."""
        return self.ordered().toLocalIterator()

    def equals(self, other: Table) -> bool:
        """Same attributes, columns and rows at the same positions."""
        if self.attrs != other.attrs or self.datatype != other.datatype or len(self) != len(other):
            return False
        if any(self.getattrs(c) != other.getattrs(c) for c in self.columns):
            return False
        cols = [RID, *self.columns]
        a, b = self.df.select(*cols), other.df.select(*cols)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def __repr__(self) -> str:
        units = {c: u for c in self.columns if (u := self.getattrs(c).get("units"))}
        return f"Table({self.datatype}" + (f", units={units}" if units else "") + (f", attrs={self.attrs}" if self.attrs else "") + ")"

    def _same(self, df: DataFrame, keep: bool = True, count: int | None = None) -> Table:
        """A table of other rows with this one's attributes; count: how many rows, where that is known."""
        out = Table(_keep_metadata(df, self.df) if keep else df, self.attrs)
        if count is not None:
            out._count = count
        elif out._count is None:
            out._count = getattr(df, "_raggedlake_count", None)
        return out

    # columns

    def select(self, names: Sequence[str]) -> Table:
        cols = []
        for n in names:
            path = S.split_path(n)
            f = S.field_at(self.df.schema, n)
            cols.append(F.col(".".join(f"`{p}`" for p in path)).alias("__".join(path), metadata=f.metadata))
        return self._same(self.df.select(RID, *cols), False, self._count)

    def column(self, path: str) -> Column:
        S.field_at(self.df.schema, path)
        return F.col(".".join(f"`{p}`" for p in S.split_path(path)))

    def add(self, path: str, value: Column | Table | Any) -> Table:
        """Add or overwrite a column, nested ones too (structs on the way are made).

        A Table of one column is joined by position, one of several becomes a nested table; anything else is a
        literal. Lists and the like are refused, as they have no row positions.
        """
        if isinstance(value, (list, tuple, dict, np.ndarray)):
            raise TypeError("a column needs row positions: give a Column, a literal or a Table")
        names = S.split_path(path)
        if isinstance(value, Table):
            inner = value.df.select(RID, (F.col(f"`{value.columns[0]}`") if len(value.columns) == 1 else F.struct(*[F.col(f"`{c}`") for c in value.columns])).alias("_new"))
            kind = inner.schema["_new"].dataType
            df = self.df.join(inner, RID, "left")
            return self._same(self._set(df, names, F.coalesce(F.col("_new"), default_of(kind)), self.df.schema).drop("_new"), count=self._count)
        return self._same(self._set(self.df, names, value if isinstance(value, Column) else F.lit(value), self.df.schema), count=self._count)

    @staticmethod
    def _set(df: DataFrame, names: list[str], value: Column, schema: T.StructType) -> DataFrame:
        if len(names) == 1:
            return df.withColumn(names[0], value)

        def build(kind: T.DataType | None, at: Column | None, rest: list[str]) -> Column:
            if not rest:
                return value
            fields = kind.fields if isinstance(kind, T.StructType) else []
            have = [f.name for f in fields]
            cols = [build(f.dataType, at[f.name], rest[1:]).alias(f.name) if f.name == rest[0] else at[f.name].alias(f.name, metadata=f.metadata) for f in fields]
            if rest[0] not in have:
                cols.append(build(None, None, rest[1:]).alias(rest[0]))
            return F.struct(*cols)

        kind = schema[names[0]].dataType if names[0] in schema.names else None
        return df.withColumn(names[0], build(kind, F.col(f"`{names[0]}`") if kind is not None else None, names[1:]))

    add_column = add

    def remove(self, path: str) -> Table:
        names = S.split_path(path)
        S.field_at(self.df.schema, path)
        if len(names) == 1:
            return self._same(self.df.drop(names[0]), count=self._count)
        return self._same(self.df.withColumn(names[0], F.col(f"`{names[0]}`").dropFields(".".join(names[1:]))), count=self._count)

    remove_column = remove

    def update(self, columns: Mapping[str, Any]) -> Table:
        """Add or overwrite several, nested mappings merged into nested tables."""
        out = self
        for k, v in columns.items():
            out = out.update({f"{k}/{n}": x for n, x in v.items()}) if isinstance(v, Mapping) else out.add(k, v)
        return out

    def flatten(self, sep: str = "__") -> Table:
        """Nested tables as columns a__b."""
        cols = [c.alias(n, metadata=f.metadata) for n, (c, f) in flat_fields(self.df.schema, sep).items()]
        return Table(self.df.select(RID, *cols), self.attrs)

    # rows by position

    def _index(self, i: int) -> int:
        n = len(self) if i < 0 else None
        at = i + n if i < 0 else i
        if at < 0:
            raise IndexError(i)
        return at

    def row(self, i: int) -> Struct:
        """The row at i as a mapping of Scalars (arrays and nested rows as Python values)."""
        got = self.df.where(F.col(RID) == self._index(int(i))).drop(RID).head(1)
        if not got:
            raise IndexError(i)
        return Struct({c: v if isinstance(v, (list, T.Row)) or v is None else Scalar(v, self.getattrs(c)) for c, v in got[0].asDict().items()})

    def slice(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> Table:
        step = 1 if step is None else step
        rid = F.col(RID)
        if step > 0 and (start or 0) >= 0 and (stop is None or stop >= 0):
            lo = start or 0
            cond = (rid >= lo) & ((rid - lo) % step == 0)
            df = self.df.where(cond if stop is None else cond & (rid < stop))
            count = None if self._count is None else len(range(*slice(start, stop, step).indices(self._count)))
            return self._same(df.withColumn(RID, ((rid - lo) / step).cast("bigint")), count=count)
        lo, hi, step = slice(start, stop, step).indices(len(self))
        if step > 0:
            return self.slice(lo, max(lo, hi), step)
        df = self.df.where((rid <= lo) & (rid > hi) & ((lo - rid) % -step == 0))
        return self._same(df.withColumn(RID, ((lo - rid) / -step).cast("bigint")), count=len(range(lo, hi, step)))

    def take(self, positions: Sequence[int] | DataFrame) -> Table:
        """Rows at these positions, in this order and as often as they are named.

        positions: a sequence, or for very many a DataFrame (pos, idx). A position of a sequence that the table doesn't
        have is an IndexError; rows of a DataFrame with such an idx give no row.
        """
        count = None
        if isinstance(positions, DataFrame):
            want = positions.select("pos", "idx")
        else:
            idx = [self._index(int(i)) for i in positions]
            count = len(idx)
            if idx and max(idx) >= len(self):
                raise IndexError(max(idx))
            want = self.spark.createDataFrame(list(enumerate(idx)), "pos bigint, idx bigint")
            if len(idx) <= BROADCAST_ROWS:
                want = F.broadcast(want)
        df = self.df.join(want, F.col(RID) == F.col("idx")).withColumn(RID, F.col("pos")).drop("pos", "idx")
        return self._same(df.select(*self.df.columns), count=count)

    def where(self, mask: Column | str) -> Table:
        """Rows for which the predicate (or expression text) is true, numbered anew."""
        cond = self._compiler().compile(mask).col if isinstance(mask, str) else mask
        return self._same(renumber(self.df.where(cond)))

    def mask(self, flags: Table) -> Table:
        """Rows where a one-column boolean table is true."""
        inner = flags.df.select(RID, F.col(f"`{flags.columns[0]}`").alias("_flag"))
        return self._same(renumber(self.df.join(inner, RID).where("_flag").drop("_flag")))

    def __getitem__(self, key: Any) -> Any:
        if isinstance(key, str):
            return self.select([key])
        if isinstance(key, (int, np.integer)) and not isinstance(key, bool):
            return self.row(int(key))
        if isinstance(key, slice):
            return self.slice(key.start, key.stop, key.step)
        if isinstance(key, Column):
            return self.where(key)
        if isinstance(key, Table):
            return self.mask(key)
        key = list(key)
        if key and isinstance(key[0], str):
            return self.select(key)
        if key and isinstance(key[0], (bool, np.bool_)):
            if len(key) != len(self):
                raise IndexError(f"a mask of {len(key)} for {len(self)} rows")
            return self.take([i for i, k in enumerate(key) if k])
        return self.take(key)

    # editing rows

    def _rows_like(self, rows: Table | Sequence[Mapping[str, Any]] | Mapping[str, Any]) -> tuple[DataFrame, int]:
        if isinstance(rows, Table):
            if sorted(rows.columns) != sorted(self.columns):
                raise ValueError("the rows have other columns")
            n = len(rows)
            return rows.df.select(RID, *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]), n
        rows = [rows] if isinstance(rows, Mapping) else list(rows)
        for r in rows:
            if sorted(r) != sorted(self.columns):
                raise ValueError("the rows have other columns")
        data = [(i, *(r[c] for c in self.columns)) for i, r in enumerate(rows)]
        fields = T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(f.name, f.dataType) for f in self.schema.fields)])
        return self.spark.createDataFrame(data, fields), len(rows)

    def insert(self, i: int, rows: Table | Sequence[Mapping[str, Any]] | Mapping[str, Any]) -> Table:
        n = len(self)
        if i > n:
            raise IndexError(i)
        i = self._index(i)
        new, k = self._rows_like(rows)
        cols = [RID, *self.columns]
        moved = self.df.withColumn(RID, F.when(F.col(RID) >= i, F.col(RID) + k).otherwise(F.col(RID))).select(*cols)
        return self._same(moved.unionByName(new.withColumn(RID, F.col(RID) + i).select(*cols)), count=n + k)

    def append(self, rows: Table | Sequence[Mapping[str, Any]] | Mapping[str, Any]) -> Table:
        return self.insert(len(self), rows)

    def replace(self, i: int, row: Mapping[str, Any]) -> Table:
        """Other values at row i; arrays may change their length."""
        i = self._index(i)
        if i >= len(self):
            raise IndexError(i)
        new, _ = self._rows_like(row)
        cols = [RID, *self.columns]
        return self._same(self.df.where(F.col(RID) != i).select(*cols).unionByName(new.withColumn(RID, F.lit(i).cast("bigint")).select(*cols)), count=len(self))

    def assign(self, path: str, positions: Sequence[int], value: Any) -> Table:
        """One value at some rows of a column."""
        idx = [self._index(int(p)) for p in positions]
        f = S.field_at(self.df.schema, path)
        return self.add(path, F.when(F.col(RID).isin(idx), F.lit(value).cast(f.dataType)).otherwise(self.column(path)))

    def resize(self, n: int) -> Table:
        """Drop rows from the end, or add rows of zeros, empty texts and empty arrays."""
        have = len(self)
        if n <= have:
            return self._same(self.df.where(F.col(RID) < n), count=n)
        more = self.spark.range(have, n).select(F.col("id").alias(RID), *[default_of(f.dataType).alias(f.name) for f in self.schema.fields])
        return self._same(self.df.select(RID, *self.columns).unionByName(more), count=n)

    def clear(self) -> Table:
        return self._same(self.df.where(F.lit(False)), count=0)

    def reserve_capacity(self, n: int) -> Table:
        """Buffers are Spark's own; there is nothing to reserve or to trim."""
        return self

    def trim_capacity(self) -> Table:
        return self

    def get_capacity(self) -> int:
        return len(self)

    # joins and expressions

    def join(self, other: Table, cols: str | Sequence[str] | None = None, keep_mine: bool = False, prefix: str = "", suffix: str = "") -> Table:
        """Add the other table's columns by position; rows it lacks get zeros, empty texts and empty arrays.

        cols: which of its columns. A name that both have is overwritten, or kept with keep_mine.
        """
        names = other.columns if cols is None else [cols] if isinstance(cols, str) else list(cols)
        named = {f"{prefix}{c}{suffix}": c for c in names}
        if keep_mine:
            named = {k: c for k, c in named.items() if k not in self.columns}
        right = other.df.select(RID, *[F.col(f"`{c}`").alias(f"_o_{k}") for k, c in named.items()])
        both = self.df.drop(*[k for k in named if k in self.columns]).join(right, RID, "left")
        cols_ = [F.coalesce(F.col(f"`_o_{k}`"), default_of(other.df.schema[c].dataType)).alias(k, metadata=other.df.schema[c].metadata) for k, c in named.items()]
        mine = [F.col(f"`{c}`") for c in self.columns if c not in named]
        return self._same(both.select(RID, *mine, *cols_), count=self._count)

    def _compiler(self, parameters: Mapping[str, Any] | None = None, modules: Mapping[str, Any] | None = None) -> Compiler:
        rows = lambda col, n: [r[0] for r in self.df.orderBy(RID).select(col).limit(n).collect()]  # noqa: E731  n: one array's width
        return Compiler(self.df.schema, parameters, modules, rows, lambda col: self.df.agg(col).first()[0])

    def eval(self, text: str, parameters: Mapping[str, Any] | None = None, modules: Mapping[str, Any] | None = None, units: str | None = None, library: str | None = None) -> Scalar | Table:
        """The value of an expression: a Scalar, or a table with the column 'value'.

        library: "np", "ak" or "lgdo", as callers may name one; all are compiled to the same columns, and any other name is an error.
        """
        if library not in (None, "np", "ak", "lgdo"):
            raise ValueError(f"no library {library!r}")
        node = self._compiler(parameters, modules).compile(text)
        meta = {"units": units} if units else {}
        if node.single:
            return Scalar(self.df.agg(node.col).first()[0], meta)
        if node.constant and node.depth == 0:
            return Scalar(self.spark.range(1).select(node.col).first()[0] if node.value is None else node.value, meta)
        if node.kind == "equalsized":
            meta[KIND] = "equalsized"
            if node.value:
                meta["shape"] = list(node.value)
        out = Table(self.df.select(RID, node.col.alias("value", metadata=meta)))
        out._count = self._count
        return out

    def with_column(self, name: str, text: str, parameters: Mapping[str, Any] | None = None, modules: Mapping[str, Any] | None = None) -> Table:
        """Add the column of an expression."""
        return self.add(name, self._compiler(parameters, modules).compile(text).col)
