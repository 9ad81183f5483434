"""Session helpers: shared scratch folders, worker import path, partition counts."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


#: Bytes of an Arrow batch, where the session leaves Spark's default: rows of long texts else make batches of 64 MB.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20)

#: Let workers, which live on between stages, give large freed blocks back instead of keeping them (glibc's and Arrow's settings).
MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where the session was started elsewhere, and bound their batches.

    On a cluster the package must be installed, or be given with --py-files; the driver's path helps where it is shared.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for name, value in MEMORY.items():
        env.setdefault(name, value)
    key, default, bound = BATCH_BYTES
    if spark.conf.get(key).rstrip("bB") in (str(default), "64m"):
        spark.conf.set(key, str(bound))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (tests on one machine) a temporary folder stands in for it.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_raggedlake_dir", None)
        if not found:
            found = spark._raggedlake_dir = "file://" + tempfile.mkdtemp(prefix="raggedlake-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the driver ends."""
    context = spark.sparkContext
    found = f"{shared_dir(spark)}/raggedlake-{context.applicationId}"
    if getattr(context, "_raggedlake_scratch", None) != found:
        context._raggedlake_scratch = found
        atexit.register(_delete, spark, found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.sparkContext.__dict__.setdefault("_raggedlake_made", [])
    made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete what materialize() wrote for df; df can't be read after that."""
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, d)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what materialize() writes meanwhile: for blocks that write their result."""
    made = spark.sparkContext.__dict__.setdefault("_raggedlake_made", [])
    before = len(made)
    try:
        yield
    finally:
        while len(made) > before:
            _delete(spark, made.pop())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
