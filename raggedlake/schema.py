"""Logical kinds of columns, their datatype strings, and attributes kept as column metadata."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RID = "_rid"
#: Metadata key of a column's logical kind: equalsized, fixedsize, detectorid, encoded, encoded_equalsized, waveform, complex, scalar.
KIND = "kind"

_NUMPY_KINDS = {"b": "bool", "V": "blob", "i": "real", "u": "real", "f": "real", "c": "complex", "S": "string", "T": "string", "U": "string"}
_TO_SPARK = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(),
}
COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])


def element_type(obj: Any) -> str:
    """bool, blob, real, complex or string for a Python or NumPy scalar, array or dtype."""
    if isinstance(obj, str):
        return "string"
    kind = np.dtype(obj).kind if isinstance(obj, (type, np.dtype)) else np.asarray(obj).dtype.kind
    if kind not in _NUMPY_KINDS:
        raise ValueError(f"no element type for {type(obj).__name__} of dtype kind {kind!r}")
    return _NUMPY_KINDS[kind]


def spark_type(dtype: Any) -> T.DataType:
    """The Spark type that holds all values of a NumPy dtype (unsigned types widen)."""
    dtype = np.dtype(dtype)
    if dtype.kind == "c":
        return COMPLEX
    if dtype.kind in "UT":
        return T.StringType()
    if dtype.kind in "SV":
        return T.BinaryType()
    if dtype.name not in _TO_SPARK:
        raise ValueError(f"no Spark type for dtype {dtype}")
    return _TO_SPARK[dtype.name]


def element_of(kind: T.DataType, meta: Mapping[str, Any] | None = None) -> str:
    """Element name of a primitive Spark type."""
    meta = meta or {}
    if meta.get(KIND) == "detectorid":
        return "detectorid"
    if kind == COMPLEX or meta.get(KIND) == "complex":
        return "complex"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "real"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BinaryType):
        return "blob"
    raise ValueError(f"no element type for {kind.simpleString()}")


def depth(kind: T.DataType) -> int:
    return 1 + depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def innermost(kind: T.DataType) -> T.DataType:
    return innermost(kind.elementType) if isinstance(kind, T.ArrayType) else kind


def datatype(kind: T.DataType, meta: Mapping[str, Any] | None = None) -> str:
    """The datatype string of a column (or, for a StructType without column, of a table)."""
    meta = meta or {}
    named = meta.get(KIND)
    if named == "scalar":
        return element_of(kind, {})
    if named in ("encoded", "encoded_equalsized"):
        elem = element_of(innermost(kind["encoded_data"].dataType if isinstance(kind, T.StructType) else kind), {})
        elem = "real" if elem == "blob" else elem
        return f"array<1>{{encoded_array<1>{{{elem}}}}}" if named == "encoded" else f"array_of_encoded_equalsized_arrays<1,1>{{{elem}}}"
    if isinstance(kind, T.StructType) and kind != COMPLEX:
        return "table{" + ",".join(sorted(f.name for f in kind.fields if f.name != RID)) + "}"
    if isinstance(kind, T.ArrayType):
        if named == "equalsized":
            return f"array_of_equalsized_arrays<1,{depth(kind)}>{{{element_of(innermost(kind))}}}"
        if named == "fixedsize":
            return f"fixedsize_array<{depth(kind)}>{{{element_of(innermost(kind))}}}"
        return f"array<1>{{{datatype(kind.elementType)}}}"
    return f"array<1>{{{element_of(kind, meta)}}}"


def struct_datatype(names: list[str]) -> str:
    """Datatype of a mapping whose members need not be of one length."""
    return "struct{" + ",".join(sorted(names)) + "}"


def fields_of(text: str) -> list[str] | None:
    """Field names in a struct{...} or table{...} string, or None."""
    for head in ("struct{", "table{"):
        if text.startswith(head) and text.endswith("}"):
            inner = text[len(head) : -1]
            return inner.split(",") if inner else []
    return None


def same_datatype(a: str, b: str) -> bool:
    """Equality that ignores the order of field names."""
    fa, fb = fields_of(a), fields_of(b)
    if fa is None or fb is None:
        return a == b
    return a.split("{")[0] == b.split("{")[0] and sorted(fa) == sorted(fb)


def check_datatype(found: str, attrs: Mapping[str, Any] | None) -> None:
    said = (attrs or {}).get("datatype")
    if said is not None and not same_datatype(said, found):
        raise ValueError(f"datatype {said!r} was given, but the data are {found!r}")


def plain(value: Any) -> Any:
    """An attribute as JSON can hold it; anything else becomes its text."""
    if isinstance(value, np.generic):
        value = value.item()
    try:
        json.dumps(value)
    except TypeError:
        return str(value)
    return value


def with_attrs(df: DataFrame, path: str, attrs: Mapping[str, Any]) -> DataFrame:
    """Set a column's attributes (a dotted or slashed path reaches nested fields)."""
    names = split_path(path)
    found = {k: plain(v) for k, v in attrs.items() if k != "datatype"}

    def build(col: Column, kind: T.DataType, meta: dict, rest: list[str], name: str) -> Column:
        if not rest:
            return col.alias(name, metadata={**{k: v for k, v in meta.items() if k == KIND}, **found})
        inner = [build(col[f.name], f.dataType, f.metadata, rest[1:], f.name) if f.name == rest[0] else col[f.name].alias(f.name, metadata=f.metadata) for f in kind.fields]
        return F.struct(*inner).alias(name, metadata=meta)

    return df.select(*[build(F.col(f"`{f.name}`"), f.dataType, f.metadata, names[1:], f.name) if f.name == names[0] else F.col(f"`{f.name}`") for f in df.schema.fields])


def field_at(schema: T.StructType, path: str) -> T.StructField:
    names = split_path(path)
    field = schema[names[0]]
    for n in names[1:]:
        field = field.dataType[n]
    return field


def get_attrs(df: DataFrame, path: str, with_datatype: bool = False) -> dict[str, Any]:
    """A copy of a column's attributes."""
    f = field_at(df.schema, path)
    out = {k: v for k, v in f.metadata.items() if k not in (KIND, "shape", "decoded_size")}
    return out | ({"datatype": datatype(f.dataType, f.metadata)} if with_datatype else {})


def split_path(path: str) -> list[str]:
    """Names in a.b or a/b, a leading separator ignored."""
    names = [n for n in path.replace("/", ".").split(".") if n]
    if not names:
        raise KeyError(path)
    return names


def check_plain(kind: T.DataType) -> None:
    """Arrays may hold numbers, truth values, texts, bytes and arrays, not records."""
    inner = innermost(kind)
    if isinstance(kind, T.ArrayType) and isinstance(inner, (T.StructType, T.MapType)):
        raise ValueError(f"arrays of {inner.simpleString()} aren't supported")
