"""NumPy's results from Spark's arithmetic: NaN never compares, logarithms and divisions never turn null or raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def compare(op: str, a: Column, b: Column, floats: bool) -> Column:
    r = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    if not floats:
        return r
    odd = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return r | odd if op == "!=" else r & ~odd


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))).otherwise(a / F.nullif(b, F.lit(0.0)))


def floor_divide(a: Column, b: Column, floats: bool) -> Column:
    if floats:
        return F.when(b == 0, divide(a, b)).otherwise(F.floor(a / F.nullif(b.cast("double"), F.lit(0.0))).cast("double"))
    # integral division truncates towards zero; the remainder tells where to step down
    a, b = a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0))
    r = a % b
    q = F.call_function("div", a, b)
    return F.coalesce(F.when((r != 0) & ((r < 0) != (b < 0)), q - 1).otherwise(q), F.when(a.isNotNull(), F.lit(0)))


def modulo(a: Column, b: Column, floats: bool) -> Column:
    zero = F.lit(0.0) if floats else F.lit(0)
    r = a % F.nullif(b, zero)
    r = F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)
    return F.coalesce(r, F.when(a.isNotNull() & b.isNotNull(), F.lit(NAN) if floats else F.lit(0)))


def power(a: Column, b: Column, floats: bool, exponent: int | None = None) -> Column:
    """exponent: the value of b where it is a literal. Integers are multiplied out; one that leaves 64 bits is an error."""
    if floats:
        return F.pow(a.cast("double"), b.cast("double"))
    a = a.cast("bigint")
    if exponent is not None and 0 <= exponent <= 64:
        out, base, n = None, a, exponent
        while n:  # squares no further than needed, as these could leave 64 bits where the power doesn't
            if n & 1:
                out = base if out is None else out * base
            n >>= 1
            if n:
                base = base * base
        return F.when(a.isNotNull(), F.lit(1).cast("bigint")) if out is None else out
    # more than 65 factors change nothing but the sign: 0, 1 and -1 stay small, all else is an error by then
    n = F.when(b > 65, b % 2 + 64).otherwise(b).cast("int")
    out = F.aggregate(F.array_repeat(a, n), F.lit(1).cast("bigint"), lambda s, x: s * x)
    wrong = F.raise_error(F.lit("integers to negative integer powers aren't integers"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b < 0, wrong.cast("bigint")).otherwise(out)


def log(x: Column, base: float | None = None) -> Column:
    x = x.cast("double")
    f = F.ln(x) if base is None else (F.log2(x) if base == 2 else F.log10(x))
    return F.when(F.isnan(x), F.lit(NAN)).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(f)


def log1p(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x), F.lit(NAN)).when(x == -1, F.lit(-INF)).when(x < -1, F.lit(NAN)).otherwise(F.log1p(x))


UNARY = {
    "sqrt": lambda x: F.sqrt(x.cast("double")), "exp": lambda x: F.exp(x.cast("double")), "expm1": lambda x: F.expm1(x.cast("double")),
    "log": log, "log10": lambda x: log(x, 10), "log2": lambda x: log(x, 2), "log1p": log1p,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh,
    "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "isnan": lambda x: F.isnan(x.cast("double")),
}
BINARY = {"arctan2": lambda a, b: F.atan2(a, b), "power": None, "minimum": F.least, "maximum": F.greatest}
