"""Cutting lineage with tables written to the shared checkpoint folder.

A written table lives as long as something can read it: :func:`sweep`, which every new table runs first, deletes those
whose scan no DataFrame holds any more, and what is left goes when the program ends. Steps that know when they are done
with a table call :func:`discard`. A result must be held as a DataFrame until it has been read; a bare RDD doesn't count.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: per written table: its session, its path and a weak reference to its scan
_written: list[tuple[SparkSession, str, object]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a folder of our own, but only on one machine.

    On a cluster every executor would write such a folder to its own disk, so that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trackloom-"))
        folder = jsc.getCheckpointDir().get()
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: recomputed by nobody, and whole if executors are lost.

    This runs the job at once, while the query is being built.
    """
    spark = df.sparkSession
    sweep()
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    scan = table._jdf.queryExecution().analyzed().relation().location()
    _written.append((spark, path, spark._jvm.java.lang.ref.WeakReference(scan)))
    return table, path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`stage` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written[:] = [w for w in _written if w[1] != path]


def sweep(every: bool = False) -> None:
    """Delete the written tables that no DataFrame can read any more, or every one."""
    for spark, path, scan in list(_written):
        if spark.sparkContext._jsc is None:  # stopped
            _written[:] = [w for w in _written if w[1] != path]
        elif every or scan.get() is None:
            discard(spark, path)


@atexit.register
def _at_exit() -> None:
    try:
        sweep(every=True)
    except Exception:  # noqa: BLE001 - the session may be gone by now
        pass
