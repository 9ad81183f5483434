"""N-dimensional weighted histograms: sparse counts by bins, made dense only on request."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above this many edges a bin is found by numpy's binary search over Arrow batches, not by a scan of a literal.
MANY_EDGES = 100


@dataclass(frozen=True)
class Axis:
    """Bins from first to last by step, or between edges; closed on the left or on the right."""

    edges: tuple[float, ...] | None = None
    first: float | None = None
    last: float | None = None
    step: float | None = None
    closedleft: bool = True
    attrs: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ranged = [self.first, self.last, self.step]
        if self.edges is None:
            if any(x is None for x in ranged):
                raise ValueError("an axis needs edges, or first, last and step")
            if self.step <= 0 or self.last <= self.first:
                raise ValueError("an axis runs upwards")
        else:
            if any(x is not None for x in ranged):
                raise ValueError("an axis has either edges or a range")
            e = np.asarray(self.edges, float)
            if e.ndim != 1 or len(e) < 2 or not (np.diff(e) > 0).all():
                raise ValueError("edges are two or more rising numbers")
            object.__setattr__(self, "edges", tuple(float(x) for x in e))

    @classmethod
    def from_edges(cls, edges: Sequence[float], attrs: Mapping[str, Any] | None = None, closedleft: bool = True) -> Axis:
        return cls(edges=tuple(np.asarray(edges, float)), closedleft=closedleft, attrs=dict(attrs or {}))

    @classmethod
    def from_range_edges(cls, edges: Sequence[float], attrs: Mapping[str, Any] | None = None, closedleft: bool = True) -> Axis:
        """A range if the edges are evenly spaced, else an error."""
        e = np.asarray(edges, float)
        if e.ndim != 1 or len(e) < 2 or not np.allclose(np.diff(e), np.diff(e).mean()):
            raise ValueError("the edges aren't evenly spaced")
        return cls(first=float(e[0]), last=float(e[-1]), step=float((e[-1] - e[0]) / (len(e) - 1)), closedleft=closedleft, attrs=dict(attrs or {}))

    @property
    def is_range(self) -> bool:
        return self.edges is None

    @property
    def nbins(self) -> int:
        return int(round((self.last - self.first) / self.step)) if self.is_range else len(self.edges) - 1

    @property
    def all_edges(self) -> np.ndarray:
        return np.linspace(self.first, self.last, self.nbins + 1) if self.is_range else np.array(self.edges)

    def inside(self, x: Column) -> Column:
        lo, hi = float(self.all_edges[0]), float(self.all_edges[-1])
        x = x.cast("double")
        return ~F.isnan(x) & ((x >= lo) & (x < hi) if self.closedleft else (x > lo) & (x <= hi))

    def bin(self, x: Column) -> Column:
        """The bin of a value that is inside."""
        x = x.cast("double")
        if self.is_range:
            q = (x - self.first) / self.step
            at = F.floor(q) if self.closedleft else F.ceil(q) - 1
            return F.greatest(F.least(at, F.lit(self.nbins - 1)), F.lit(0)).cast("int")
        if len(self.edges) > MANY_EDGES:
            edges, side = np.array(self.edges), "right" if self.closedleft else "left"

            @F.pandas_udf("int")
            def search(v: pd.Series) -> pd.Series:
                return pd.Series(np.searchsorted(edges, v.to_numpy(), side).astype("int32") - 1)

            return search(x)
        edges = F.array(*[F.lit(e) for e in self.edges])
        return (F.size(F.filter(edges, lambda e: e <= x if self.closedleft else e < x)) - 1).cast("int")


@dataclass(frozen=True)
class Histogram:
    """Axes and sparse counts (bin_0, bin_1 ..., weight); counts None means empty."""

    axes: tuple[Axis, ...]
    counts: DataFrame | None = None
    isdensity: bool = False
    spark: SparkSession | None = None

    @classmethod
    def make(cls, binning: Sequence[Axis | Sequence[float]], weights: np.ndarray | None = None, spark: SparkSession | None = None, isdensity: bool = False) -> Histogram:
        """binning: axes, (first, last, step) tuples, or arrays of edges; weights: a dense array to begin with."""
        if not binning:
            raise ValueError("a histogram has axes")
        axes = tuple(a if isinstance(a, Axis) else Axis(first=float(a[0]), last=float(a[1]), step=float(a[2])) if isinstance(a, tuple) and len(a) == 3 else Axis.from_edges(a) for a in binning)
        h = cls(axes, None, isdensity, spark)
        if weights is None:
            return h
        weights = np.asarray(weights)
        if weights.shape != h.shape:
            raise ValueError(f"weights of shape {weights.shape} don't fit bins of shape {h.shape}")
        rows = [(*map(int, i), float(weights[i])) for i in np.ndindex(*weights.shape)]
        return cls(axes, spark.createDataFrame(rows, ", ".join([*(f"{n} int" for n in h.names), "weight double"])), isdensity, spark)

    @property
    def names(self) -> list[str]:
        return [f"bin_{i}" for i in range(len(self.axes))]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(a.nbins for a in self.axes)

    def count(self, df: DataFrame, columns: Sequence[Column | str] | None = None, weight: Column | str | None = None) -> DataFrame:
        """Sparse counts of rows; those outside an axis, NaN and null are left out. columns default to all of df."""
        cols = [F.col(f"`{c}`") if isinstance(c, str) else c for c in (df.columns if columns is None else columns)]
        if len(cols) != len(self.axes):
            raise ValueError(f"{len(cols)} columns for {len(self.axes)} axes")
        keep = F.lit(True)
        for a, c in zip(self.axes, cols):
            keep = keep & a.inside(c)
        w = None if weight is None else F.col(f"`{weight}`") if isinstance(weight, str) else weight
        total = F.count(F.lit(1)) if w is None else F.sum(w)
        return df.where(keep).groupBy(*[a.bin(c).alias(n) for a, c, n in zip(self.axes, cols, self.names)]).agg(total.alias("weight"))

    def fill(self, df: DataFrame, columns: Sequence[Column | str] | None = None, weight: Column | str | None = None) -> Histogram:
        """The histogram with these rows added."""
        if self.isdensity:
            raise ValueError("a density can't be filled")
        if not isinstance(df, DataFrame):
            if self.spark is None:
                raise ValueError("arrays need a session: make(..., spark=...)")
            df, columns = self._frame(df, columns)
        new = self.count(df, columns, weight)
        if self.counts is not None:
            new = self.counts.unionByName(new).groupBy(*self.names).agg(F.sum("weight").alias("weight"))
        return Histogram(self.axes, new, spark=self.spark)

    def _frame(self, data: Any, keys: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
        """Rows of an array (one column an axis), a sequence of arrays, a mapping of arrays (with keys: which) or a pandas frame."""
        if isinstance(data, pd.DataFrame):
            data = {str(c): data[c].to_numpy() for c in data.columns}
        if isinstance(data, Mapping):
            cols = [np.asarray(data[k], float) for k in (keys if keys is not None else data)]
        elif isinstance(data, np.ndarray):
            cols = [data.astype(float)] if data.ndim == 1 else list(data.astype(float).T)
        else:
            cols = [np.asarray(c, float) for c in data]
        if len({len(c) for c in cols}) > 1:
            raise ValueError("arrays of different lengths")
        if len(cols) != len(self.axes):
            raise ValueError(f"{len(cols)} columns for {len(self.axes)} axes")
        names = [f"x{i}" for i in range(len(cols))]
        return self.spark.createDataFrame(pd.DataFrame(dict(zip(names, cols))), ", ".join(f"{n} double" for n in names)), names

    @property
    def weights(self) -> np.ndarray:
        if self.spark is None and self.counts is not None:
            return self.to_numpy(self.counts.sparkSession)[0]
        return self.to_numpy(self.spark)[0] if self.counts is not None else np.zeros(self.shape)

    def view_as(self, library: str = "np", spark: SparkSession | None = None) -> Any:
        """"np": weights and edges. "hist": the boost-histogram object, where that package is installed and no bin is closed on the right."""
        if library == "np":
            return self.to_numpy(spark or self.spark)
        if library != "hist":
            raise ValueError(f"no view for {library!r}")
        if self.isdensity or not all(a.closedleft for a in self.axes):
            raise ValueError("a density, or bins closed on the right, have no such view")
        import hist

        axes = [hist.axis.Regular(a.nbins, a.first, a.last) if a.is_range else hist.axis.Variable(list(a.edges)) for a in self.axes]
        out = hist.Hist(*axes)
        out[...] = self.weights
        return out

    @classmethod
    def from_hist(cls, h: Any, spark: SparkSession, isdensity: bool = False) -> Histogram:
        """A histogram of an object with axes of edges and values(), as the hist package has them; under- and overflow are left out."""
        return cls.make([Axis.from_edges(np.asarray(a.edges)) for a in h.axes], np.asarray(h.values()), spark, isdensity)

    def dense(self, spark: SparkSession) -> DataFrame:
        """All bins, zeros too."""
        n = int(np.prod(self.shape))
        grid, left = spark.range(n), F.col("id")
        cols = []
        for size, name in reversed(list(zip(self.shape, self.names))):
            cols.append((left % size).cast("int").alias(name))
            left = F.floor(left / size)
        grid = grid.select(*reversed(cols))
        if self.counts is None:
            return grid.withColumn("weight", F.lit(0).cast("bigint"))
        zero = F.lit(0).cast(self.counts.schema["weight"].dataType)
        return grid.join(self.counts, self.names, "left").withColumn("weight", F.coalesce("weight", zero))

    def to_numpy(self, spark: SparkSession) -> tuple[np.ndarray, list[np.ndarray]]:
        """Dense weights (as many as the bins, whatever the data) and edges."""
        out = np.zeros(self.shape)
        if self.counts is not None:
            for r in self.counts.collect():
                out[tuple(r[n] for n in self.names)] = r["weight"]
        return out, [a.all_edges for a in self.axes]
