"""Helpers shared by the training-data operators: shipping code, work folders, Arrow columns."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import workers

#: Word of the contracts: a run of bytes other than blank, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and bound Arrow batches by bytes."""
    workers.ship(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is named, a local master gets a temporary one; on a cluster that raises, as executors wouldn't share it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        have = spark.sparkContext.getCheckpointDir()
        if not have:
            if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
            have = spark.sparkContext.getCheckpointDir()
        d = have
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


_written: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there when the application ends goes."""
    if not _written:
        atexit.register(_clean)
    _written.append(f"{checkpoint_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}")
    return _written[-1]


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written if spark else ():
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone
            return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def volume(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column (one scan of that column)."""
    n, b = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(n), int(b)


def rough_bytes(docs: DataFrame, text: str = "text") -> int:
    """Spark's own estimate of a table's size (of files: what they take), without a scan; the texts' bytes where it has none."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else volume(docs, text)[1]


def parts_for(nbytes: int, each: int = 8 << 20, least: int = 12) -> int:
    return max(least, -(-nbytes // each))


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(concatenated UTF-8 bytes, row offsets) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]: offs[-1]], offs - offs[0]


def trim(collect: bool = True) -> None:
    """Give what this worker has freed back to the machine: a worker lives on after its task, and its memory counts as the executor's."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def release_and_trim() -> None:
    """What ``lean`` does, for functions over groups: at the beginning of each, what the group before has left is freed."""
    from tessera.llm.tokens import release

    release()
    trim(collect=False)


def lean(run, keep_encoders: bool = False):
    """A task's function over batches that begins without tokenisers kept by earlier tasks and gives freed memory back at its end."""

    def task(batches):
        from tessera.llm.tokens import release

        if not keep_encoders:
            release()
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def unused(columns: list[str], name: str) -> str:
    """``name``, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quiet_threads() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
