"""Helpers shared by the operators: reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Word characters are everything but these blanks (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests on one machine) a temporary folder
    is made and set as checkpoint directory.
    """
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="quadrat-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; removed when the driver exits."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def tidy(run):
    """``run`` for ``mapInArrow``, giving memory back at its end.

    Python workers outlive their tasks; what a task held would stay with them and
    count against the executor while other stages run.
    """

    def wrapped(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not the GNU library
            pass

    return wrapped


def by_bytes(batch, column: int, most: int):
    """Slices of an Arrow batch whose texts in ``column`` have about ``most`` bytes together."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        z = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, z - at)
        at = z


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM is already gone; the shared folder's owner cleans up
        pass


def keep(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there.

    A lost executor costs a reread, never a recomputation, and the table counts
    as one scan in every plan built on it.
    """
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
