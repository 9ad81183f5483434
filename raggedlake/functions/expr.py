"""Expressions over a table's columns, parsed with Python's grammar and compiled to Spark columns; never eval()ed.

Names are columns (nested ones as a__b), or parameters, which hide columns of the same name. Flat columns,
arrays and nested arrays mix: a flat value is used for each element of its row's array. Reductions (np.sum ...)
give one value for the table, or with axis=-1 one for each row.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raggedlake.functions import numeric
from raggedlake.schema import KIND, RID, depth, innermost

_BIN = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.BitAnd: "&", ast.BitOr: "|", ast.BitXor: "^"}
_CMP = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
_REDUCE = {"sum", "prod", "min", "max", "mean", "any", "all", "count"}


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """A compiled part: col; depth of arrays; elem int, float, bool or string; whether it is one value for the table.

    constant: made of literals and parameters alone. value: a literal's value, or the shape of a column's arrays.
    """

    col: Column
    depth: int
    elem: str
    single: bool = False
    kind: str = ""
    value: Any = None
    constant: bool = False


def _elem(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
        return "int"
    if isinstance(kind, T.NumericType):
        return "float"
    if isinstance(kind, T.StringType):
        return "string"
    raise ExpressionError(f"columns of type {kind.simpleString()} can't be computed with")


def flat_fields(schema: T.StructType, sep: str = "__") -> dict[str, tuple[Column, T.StructField]]:
    """Flattened name to column and field, structs taken apart."""
    out: dict[str, tuple[Column, T.StructField]] = {}

    def walk(prefix: str, col: Callable[[str], Column], fields: list[T.StructField]) -> None:
        for f in fields:
            if f.name == RID:
                continue
            c = col(f.name)
            if isinstance(f.dataType, T.StructType) and f.metadata.get(KIND) not in ("encoded", "complex"):
                walk(f"{prefix}{f.name}{sep}", (lambda c: lambda n: c.getField(n))(c), f.dataType.fields)
            else:
                out[prefix + f.name] = (c, f)

    walk("", lambda n: F.col(f"`{n}`"), schema.fields)
    return out


def _lift(f: Callable[[Column], Column], x: Column, levels: int) -> Column:
    return f(x) if levels == 0 else F.transform(x, lambda v: _lift(f, v, levels - 1))


def _lift2(f: Callable[[Column, Column], Column], a: Column, da: int, b: Column, db: int) -> Column:
    if da == 0 and db == 0:
        return f(a, b)
    if da == 0:
        return F.transform(b, lambda v: _lift2(f, a, 0, v, db - 1))
    if db == 0:
        return F.transform(a, lambda v: _lift2(f, v, da - 1, b, 0))
    if da != db:
        raise ExpressionError("arrays of different depth can't be combined")
    zipped = F.zip_with(a, b, lambda u, v: _lift2(f, u, da - 1, v, db - 1))
    return F.when(F.size(a) == F.size(b), zipped).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("arrays of one row differ in length")))


class Compiler:
    """Compiles one expression against a schema. rows gives vectors for NumPy's last-axis rule, scalar evaluates a reduction."""

    def __init__(self, schema: T.StructType, parameters: Mapping[str, Any] | None = None, modules: Mapping[str, Any] | None = None, rows: Callable[[Column, int], list] | None = None, scalar: Callable[[Column], Any] | None = None):
        self.fields = flat_fields(schema)
        self.parameters, self.modules = dict(parameters or {}), dict(modules or {})
        self.rows, self.scalar = rows, scalar

    def compile(self, text: str) -> Node:
        try:
            tree = ast.parse(text, mode="eval")
        except SyntaxError as e:
            raise ExpressionError(f"not an expression: {text!r}") from e
        return self.visit(tree.body)

    def visit(self, node: ast.AST) -> Node:
        found = getattr(self, "on_" + type(node).__name__, None)
        if found is None:
            raise ExpressionError(f"{type(node).__name__} isn't supported in expressions")
        return found(node)

    def literal(self, value: Any) -> Node:
        if hasattr(value, "item") and getattr(value, "ndim", 0) == 0:
            value = value.item()
        if isinstance(value, bool):
            return Node(F.lit(value), 0, "bool", value=value, constant=True)
        if isinstance(value, int):
            return Node(F.lit(value).cast("bigint"), 0, "int", value=value, constant=True)
        if isinstance(value, float):
            return Node(F.lit(value), 0, "float", value=value, constant=True)
        if isinstance(value, str):
            return Node(F.lit(value), 0, "string", value=value, constant=True)
        if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
            items = [self.literal(v) for v in (value.tolist() if hasattr(value, "tolist") else value)]
            elem = "float" if any(i.elem == "float" for i in items) else items[0].elem if items else "float"
            return Node(F.array(*[i.col.cast("double") if elem == "float" and i.depth == 0 else i.col for i in items]), 1 + (items[0].depth if items else 0), elem)
        raise ExpressionError(f"a parameter of type {type(value).__name__} can't be used")

    def on_Constant(self, node: ast.Constant) -> Node:
        return self.literal(node.value)

    def on_Name(self, node: ast.Name) -> Node:
        if node.id in self.parameters:
            return self.literal(self.parameters[node.id])
        if node.id in self.fields:
            col, f = self.fields[node.id]
            return Node(col, depth(f.dataType), _elem(innermost(f.dataType)), kind=f.metadata.get(KIND, ""), value=f.metadata.get("shape"))
        raise ExpressionError(f"no column or parameter named {node.id!r}")

    def on_Attribute(self, node: ast.Attribute) -> Node:
        value = self.python(node)
        return self.literal(value)

    def python(self, node: ast.AST) -> Any:
        """A Python object reached by attributes from a parameter."""
        if isinstance(node, ast.Name):
            if node.id in self.parameters:
                return self.parameters[node.id]
            raise ExpressionError(f"{node.id!r} isn't a parameter")
        if isinstance(node, ast.Attribute) and not node.attr.startswith("_"):
            owner = self.python(node.value)
            return owner[node.attr] if isinstance(owner, Mapping) else getattr(owner, node.attr)
        raise ExpressionError("only plain attributes of parameters can be used")

    def on_UnaryOp(self, node: ast.UnaryOp) -> Node:
        x = self.visit(node.operand)
        if isinstance(node.op, ast.USub):
            if x.constant and x.elem in ("int", "float") and x.value is not None:
                return self.literal(-x.value)
            return Node(_lift(lambda v: -v, x.col, x.depth), x.depth, x.elem, x.single, x.kind, x.value, x.constant)
        if isinstance(node.op, ast.UAdd):
            return x
        if isinstance(node.op, (ast.Invert, ast.Not)):
            return Node(_lift(lambda v: ~v if x.elem == "bool" else F.bitwise_not(v), x.col, x.depth), x.depth, x.elem, x.single, x.kind, constant=x.constant)
        raise ExpressionError("unary operator isn't supported")

    def on_BoolOp(self, node: ast.BoolOp) -> Node:
        raise ExpressionError("use & and | on columns, not 'and' and 'or'")

    def pair(self, a: Node, b: Node, f: Callable[[Column, Column], Column], elem: str) -> Node:
        if a.single != b.single:  # a table's value beside rows: evaluate it, it is one number
            if a.single and not b.constant:
                a = self.literal(self._value(a))
            elif b.single and not a.constant:
                b = self.literal(self._value(b))
        for x, y in ((a, b), (b, a)):
            if x.kind == "equalsized" and y.depth == 0 and not y.constant and not y.single:
                wide = self._last_axis(x, y)
                a, b = (a, wide) if x is a else (wide, b)
        return Node(_lift2(f, a.col, a.depth, b.col, b.depth), max(a.depth, b.depth), elem, a.single or b.single, a.kind or b.kind, a.value if a.kind else b.value if b.kind else None, a.constant and b.constant)

    def _value(self, n: Node) -> Any:
        if self.scalar is None:
            raise ExpressionError("a reduction can't be mixed with rows here")
        return self.scalar(n.col)

    def _last_axis(self, wide: Node, flat: Node) -> Node:
        """NumPy aligns a flat array with the last axis of a two-dimensional one."""
        if self.rows is None or not wide.value:
            raise ExpressionError("the width of the equal-sized column isn't known")
        width = wide.value[-1]
        values = self.rows(flat.col, width + 1)
        if len(values) == 1:
            return self.literal(values[0])
        if len(values) != width or wide.depth != 1:
            raise ExpressionError(f"a column of other than {width} rows can't be aligned with arrays of {width}")
        return self.literal(values)

    def on_BinOp(self, node: ast.BinOp) -> Node:
        op = _BIN.get(type(node.op))
        if op is None:
            raise ExpressionError("operator isn't supported")
        a, b = self.visit(node.left), self.visit(node.right)
        floats = "float" in (a.elem, b.elem)
        if "string" in (a.elem, b.elem):
            raise ExpressionError("no arithmetic on text")
        if op in "&|^":
            if a.elem == b.elem == "bool":
                f = {"&": lambda x, y: x & y, "|": lambda x, y: x | y, "^": lambda x, y: x != y}[op]
                return self.pair(a, b, f, "bool")
            return self.pair(a, b, {"&": lambda x, y: x.bitwiseAND(y), "|": lambda x, y: x.bitwiseOR(y), "^": lambda x, y: x.bitwiseXOR(y)}[op], "int")
        a, b = (Node(_lift(lambda v: v.cast("bigint"), x.col, x.depth), x.depth, "int", x.single, x.kind, x.value, x.constant) if x.elem != "float" else x for x in (a, b))
        if op == "/":
            return self.pair(a, b, numeric.divide, "float")
        f = {
            "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y,
            "//": lambda x, y: numeric.floor_divide(x, y, floats), "%": lambda x, y: numeric.modulo(x, y, floats), "**": lambda x, y: numeric.power(x, y, floats, b.value if b.constant else None),
        }[op]
        if op == "**" and not floats and b.constant and isinstance(b.value, int) and b.value < 0:
            raise ExpressionError("integers to negative integer powers aren't integers")
        return self.pair(a, b, f, "float" if floats else "int")

    def on_Compare(self, node: ast.Compare) -> Node:
        if len(node.ops) != 1:
            raise ExpressionError("write a < b < c as (a < b) & (b < c)")
        op = _CMP.get(type(node.ops[0]))
        if op is None:
            raise ExpressionError("comparison isn't supported")
        a, b = self.visit(node.left), self.visit(node.comparators[0])
        floats = "float" in (a.elem, b.elem)
        return self.pair(a, b, lambda x, y: numeric.compare(op, x, y, floats), "bool")

    def on_Call(self, node: ast.Call) -> Node:
        module, name = None, None
        if isinstance(node.func, ast.Name):
            name = node.func.id
        elif isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name):
            module, name = node.func.value.id, node.func.attr
        if name is None or name.startswith("_"):
            raise ExpressionError("only plain function calls are supported")
        axis = next((ast.literal_eval(k.value) for k in node.keywords if k.arg == "axis"), None)
        known = module in (None, "np", "ak", "numpy")
        if known and name in numeric.UNARY:
            x = self.visit(node.args[0])
            elem = "bool" if name == "isnan" else "float"
            return Node(_lift(numeric.UNARY[name], x.col, x.depth), x.depth, elem, x.single, x.kind, x.value if x.kind else None, x.constant)
        if known and name in ("abs", "absolute"):
            x = self.visit(node.args[0])
            return Node(_lift(F.abs, x.col, x.depth), x.depth, x.elem, x.single, x.kind, x.value if x.kind else None, x.constant)
        if known and name in numeric.BINARY:
            a, b = map(self.visit, node.args)
            floats = name == "arctan2" or "float" in (a.elem, b.elem)
            f = (lambda x, y: numeric.power(x, y, floats, b.value if b.constant and isinstance(b.value, int) else None)) if name == "power" else numeric.BINARY[name]
            return self.pair(a, b, f, "float" if floats else "int")
        if known and name == "where":
            c, a, b = map(self.visit, node.args)
            return self.where(c, a, b)
        if known and name in ("num", "len") and axis in (None, 1, -1):
            x = self.visit(node.args[0])
            if not x.depth:
                raise ExpressionError(f"{name}() needs arrays; count() counts rows")
            return Node(F.size(x.col).cast("bigint"), 0, "int")
        if known and name == "flatten":
            x = self.visit(node.args[0])
            if x.depth < 2:
                raise ExpressionError("flatten needs arrays of arrays; explode a single level instead")
            return Node(F.flatten(x.col), x.depth - 1, x.elem)
        if known and name == "firsts":
            x = self.visit(node.args[0])
            return Node(F.get(x.col, F.lit(0)), x.depth - 1, x.elem)
        if known and name in _REDUCE:
            return self.reduce(name, self.visit(node.args[0]), axis)
        owner = self.modules.get(module)
        call = getattr(owner, name, None) if not isinstance(owner, Mapping) else owner.get(name)
        if callable(call):
            return self.python_function(call, [self.visit(a) for a in node.args])
        raise ExpressionError(f"no function {name!r}")

    def where(self, c: Node, a: Node, b: Node) -> Node:
        elem = "float" if "float" in (a.elem, b.elem) else a.elem
        if c.depth == 0:
            a2, b2 = (Node(_lift(lambda v: v.cast("double"), x.col, x.depth), x.depth, elem) if elem == "float" else x for x in (a, b))
            if a2.depth != b2.depth:
                raise ExpressionError("where() needs values of one depth")
            return Node(F.when(c.col, a2.col).otherwise(b2.col), a2.depth, elem, constant=c.constant and a.constant and b.constant)
        both = self.pair(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")), elem)
        if both.depth not in (0, c.depth):
            raise ExpressionError("where() needs values of one depth")
        return Node(_lift2(lambda k, v: F.when(k, v["x"]).otherwise(v["y"]), c.col, c.depth, both.col, both.depth), c.depth, elem)

    def reduce(self, name: str, x: Node, axis: int | None) -> Node:
        elem = {"any": "bool", "all": "bool", "count": "int", "mean": "float"}.get(name, "int" if x.elem == "bool" and name in ("sum", "prod") else x.elem)
        value = _lift(lambda v: v.cast("double"), x.col, x.depth) if name == "mean" else _lift(lambda v: v.cast("bigint"), x.col, x.depth) if x.elem in ("bool", "int") and name in ("sum", "prod") else x.col
        if axis in (-1, x.depth) and x.depth:
            return Node(_lift(lambda v: self.over_array(name, v, elem), value, x.depth - 1), x.depth - 1, elem)
        if axis not in (None, 0):
            raise ExpressionError(f"axis {axis} isn't supported")
        if x.depth:
            if axis == 0:
                raise ExpressionError("axis 0 of arrays isn't supported")
            inner = "sum" if name in ("sum", "count", "mean") else name
            flat = value
            for _ in range(x.depth - 1):
                flat = F.flatten(flat)
            if name == "mean":
                total = F.sum(self.over_array("sum", flat, "float"))
                return Node(numeric.divide(total, F.sum(F.size(flat))), 0, "float", True)
            if name == "count":
                return Node(F.coalesce(F.sum(F.size(flat)), F.lit(0)).cast("bigint"), 0, "int", True)
            return Node(self.over_rows(inner, self.over_array(inner, flat, elem), elem), 0, elem, True)
        return Node(self.over_rows(name, value, elem), 0, elem, True)

    @staticmethod
    def over_array(name: str, v: Column, elem: str) -> Column:
        zero, one = (F.lit(0.0), F.lit(1.0)) if elem == "float" else (F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))
        if name == "sum":
            return F.aggregate(v, zero, lambda s, x: s + x)
        if name == "prod":
            return F.aggregate(v, one, lambda s, x: s * x)
        if name == "mean":
            return numeric.divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.size(v))
        if name == "count":
            return F.size(v).cast("bigint")
        if name == "any":
            return F.exists(v, lambda x: x.cast("boolean"))
        if name == "all":
            return F.forall(v, lambda x: x.cast("boolean"))
        return F.array_min(v) if name == "min" else F.array_max(v)

    @staticmethod
    def over_rows(name: str, v: Column, elem: str) -> Column:
        if name == "sum":  # no rows: 0, as in NumPy
            return F.coalesce(F.sum(v), F.lit(0.0) if elem == "float" else F.lit(0).cast("bigint"))
        if name == "prod":
            return F.coalesce(F.product(v), F.lit(1.0)).cast("double" if elem == "float" else "bigint")
        if name == "any":
            return F.coalesce(F.bool_or(v.cast("boolean")), F.lit(False))
        if name == "all":
            return F.coalesce(F.bool_and(v.cast("boolean")), F.lit(True))
        return {"min": F.min, "max": F.max, "mean": F.avg, "count": F.count}[name](v)

    def python_function(self, call: Callable, args: list[Node]) -> Node:
        """A user's vectorised function, over Arrow batches; its return type is call.returnType, else double."""
        kind = getattr(call, "returnType", "double")

        def run(*cols: pd.Series) -> pd.Series:
            return pd.Series(call(*[c.to_numpy() for c in cols]))

        run.__annotations__ = {}
        parsed = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
        udf = F.pandas_udf(run, returnType=parsed, functionType=F.PandasUDFType.SCALAR)
        return Node(udf(*[a.col for a in args]), depth(parsed), _elem(innermost(parsed)))
