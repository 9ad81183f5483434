"""Contiguous row numbers for positional operators, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raggedlake.plans.session import materialize, shuffle_partitions
from raggedlake.schema import RID


def with_row_id(df: DataFrame, order_by: list[str], partitions: int | None = None) -> DataFrame:
    """df with the column _rid: 0, 1, 2 ... in the order of order_by (ties by a hash of the other columns, then by these).

    The hash belongs to the ranges too, so rows with one value of order_by don't have to meet in one task.

    Rows are range-partitioned and sorted, numbered inside their partitions and written once; the partitions'
    row counts (one number a partition) then give the offsets. The written order is final, so a lost executor
    can't change it.
    """
    # sorting takes columns of any orderable type; the rest can't break ties
    rest = [f.name for f in df.schema.fields if f.name not in (*order_by, RID) and "map<" not in f.dataType.simpleString()]
    ranges = [F.col(f"`{c}`") for c in order_by] + ([F.xxhash64(*[F.col(f"`{c}`") for c in rest])] if rest else [])
    keys = [*ranges, *[F.col(f"`{c}`") for c in rest]]
    n = partitions or shuffle_partitions(df.sparkSession)
    rows = df.drop(RID).repartitionByRange(n, *ranges).sortWithinPartitions(*keys)
    rows = rows.withColumn("_p", F.spark_partition_id())
    rows = rows.withColumn("_k", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("bigint"), 33))
    rows = materialize(rows, "rowid")
    counts = {r["_p"]: r["c"] for r in rows.groupBy("_p").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row a partition
    offsets, total = [], 0
    for p in range(max(counts, default=0) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    at = F.get(F.array(*[F.lit(o).cast("bigint") for o in offsets]), F.col("_p"))
    out = rows.withColumn(RID, at + F.col("_k")).drop("_p", "_k")
    out._raggedlake_count = total  # known by now; tables that keep the rows needn't count them again
    return out


def renumber(df: DataFrame) -> DataFrame:
    """Close gaps in _rid after rows went or came; the order stays."""
    numbered = with_row_id(df.withColumnRenamed(RID, "_old"), ["_old"])
    out = numbered.drop("_old")
    out._raggedlake_count = numbered._raggedlake_count
    return out
