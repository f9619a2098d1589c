"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker handles at a time.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch, where the session has the default of 64 MB.
BATCH_BYTES = 8 << 20
_shipped: set[str] = set()
_state: dict = {}
_stored: list[DataFrame] = []


def worker_state(key, make):
    """What an operator keeps in a worker from task to task; that of one operator at a time.
    Arrow's buffers then come from the system, which gets them back sooner than from a pool."""
    if key not in _state:
        pa.set_memory_pool(pa.system_memory_pool())
        _state.clear()
        _state[key] = make()
    return _state[key]


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of a cluster, once an application,
    and its batches small enough for several workers beside an executor."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        package = os.path.basename(os.path.dirname(here))
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr(f"{package}/__init__.py", "")
            for name in sorted(os.listdir(here)):
                if name.endswith(".py"):
                    z.write(os.path.join(here, name), f"{package}/llm/{name}")
        path = os.path.join(tempfile.mkdtemp(), f"{package}_llm.zip")
        with open(path, "wb") as f:
            f.write(buffer.getvalue())
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a
    temporary folder of this machine if all runs in one process (tests); else an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def until_exit(spark: SparkSession, path: str) -> Callable[[], None]:
    """Have a folder removed when the JVM ends; what is returned removes it now."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(at)
    return lambda: files.delete(at, True)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back, so that what follows neither
    recomputes it nor loses it with an executor. Removed when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._drop = until_exit(spark, path)
    _stored.append(out)
    return out


@contextlib.contextmanager
def scratch():
    """Tables that are stored inside go at the end, but for those put into the list it gives."""
    begin, keep = len(_stored), []
    try:
        yield keep
    finally:
        drop(*(t for t in _stored[begin:] if not any(t is k for k in keep)))
        _stored[begin:] = keep


def few(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has that many rows at most; else Spark joins by key."""
    return F.broadcast(df) if few(df, rows) else df


def free_name(base: str, df: DataFrame) -> str:
    """base, or base and as many underscores as it takes, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def drop(*tables: DataFrame) -> None:
    """Remove tables of stored() that nothing will read any more."""
    for t in tables:
        t._drop()


def fold(column, modulus: int):
    """crc32 of the id as text, modulo modulus (null where the id is null)."""
    return F.crc32(column.cast("string")) % modulus


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """(start, end) ranges of texts that hold about limit characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
