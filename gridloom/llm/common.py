"""Helpers that the operators of this subpackage share: tables on the shared folder, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all tasks run in the driver."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again.

    This cuts the lineage: a lost executor costs only its own tasks, as the files are where all
    executors and the driver see them. The path is kept for :func:`release`; what nothing releases goes when the
    driver ends, or unless ``keep`` at the end of the innermost :func:`scratch`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    place, fs = _file_system(out)
    fs.deleteOnExit(place)
    if _OPEN and not keep:
        _OPEN[-1].append(out)
    return out


def _file_system(df: DataFrame):
    """The path of a materialised DataFrame and its file system, as the JVM has them."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
    return path, path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


_OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Releases at its end all that was materialised within, so a result must be written before."""
    _OPEN.append([])
    try:
        yield
    finally:
        release(*_OPEN.pop())


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a DataFrame that :func:`materialise` returned."""
    path, fs = _file_system(df)
    return fs.getContentSummary(path).getLength()


def release(*dfs: DataFrame | None) -> None:
    """Deletes the files of materialised DataFrames that nothing reads any more."""
    for df in dfs:
        if df is not None and getattr(df, "_gridloom_path", None):
            path, fs = _file_system(df)
            fs.delete(path, True)


def small_or_shuffled(df: DataFrame, factor: int = 8) -> DataFrame:
    """``df`` (materialised) with a broadcast hint if its measured size allows it, else as it is.

    ``factor`` allows for what compressed files take in memory. Without the hint Spark joins by a
    shuffle, whose skewed partitions adaptive execution splits.
    """
    return F.broadcast(df) if stored_bytes(df) * factor <= BROADCAST_BYTES else df.hint("merge")


def remainder(doc_id, mod: int):
    """crc32 of the decimal text of an id, modulo ``mod``; null for a null id."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % mod


def unused_names(df: DataFrame, *wanted: str) -> dict[str, str]:
    """For each name one that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in wanted:
        free = f"_{name}"
        while free.lower() in taken:
            free = f"_{free}"
        taken.add(free.lower())
        out[name] = free
    return out
