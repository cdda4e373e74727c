"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or (unset and all in one process, as in tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext.getCheckpointDir()
        if made is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
            made = spark.sparkContext.getCheckpointDir()
        found = made
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Lineage ends there, so a lost executor costs a re-read and not a recomputation, and the planner gets
    real sizes. Returns the table and its path (for ``forget``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made and that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_caches: dict[str, Callable[[], None]] = {}
_owner: list[str] = [""]


def remembers(name: str, clear: Callable[[], None]) -> None:
    """Declare what an operator keeps in a worker process between tasks, and how to let go of it."""
    _caches[name] = clear


def claim(name: str) -> None:
    """Called by an operator as a task begins: workers are reused, so what others keep is let go."""
    if _owner[0] != name:
        for other, clear in _caches.items():
            if other != name:
                clear()
        _owner[0] = name


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """A string column as str, null as empty."""
    return [x or "" for x in column.to_pylist()]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """``batch`` with column ``name`` replaced, or appended when it has none."""
    names = batch.schema.names
    arrays = [values if n == name else a for n, a in zip(names, batch.columns, strict=True)]
    if name not in names:
        names, arrays = [*names, name], [*arrays, values]
    return pa.RecordBatch.from_arrays(arrays, names=names)
