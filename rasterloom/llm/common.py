"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that reaches a Python worker; texts may be long, so it stays small.
ARROW_ROWS = 250
ARROW_BYTES = 2 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that Python workers hold at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, ready for the Python operators."""
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session in one process (tests) gets a folder of its own; any other raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _own_roots:
        _own_roots[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    return _own_roots[context.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it is deleted when the driver ends."""
    path = f"{shared_root(spark)}/rasterloom-{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file system; a session that has ended is no error."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is gone at exit
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and rereads it, which cuts its lineage at a table that outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def restage(df: DataFrame, name: str, last: str | None) -> tuple[DataFrame, str]:
    """As stage, for rounds: (rows reread, their folder); the folder of the last round, which df was made from, is deleted."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/rasterloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if last:
        delete(spark, last)
    return spark.read.schema(df.schema).parquet(path), path


def tidy(spark: SparkSession) -> None:
    """Lets the driver's collector run, so that shuffle files that no plan needs any more are removed from executors' disks."""
    spark.sparkContext._jvm.System.gc()


def arrow_fs(uri: str):
    """(file system, path) of a shared folder, for use inside a Python worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def together(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches brought together, in order, until they have that many rows or bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def crc_mod(column: str, m: int):
    """crc32 of the id's decimal text, modulo m; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % m, F.lit(0))
