"""Tables that cut lineage and survive lost executors.

Intermediate results are written as Parquet under ``spark.checkpoint.dir``,
the folder that all executors share.  Where that setting is missing, a session
in one process (as in tests) uses a folder of this machine, and any other one
is refused.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if not found.isDefined() and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = found.get() if found.isDefined() else tempfile.gettempdir() + "/goldweave-checkpoints"
    return root.rstrip("/")


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/goldweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._goldweave_path = path
    return out


def is_durable(df: DataFrame) -> bool:
    return hasattr(df, "_goldweave_path")


def forget(df: DataFrame) -> None:
    """Delete a durable table that no pending plan reads any more."""
    path = getattr(df, "_goldweave_path", None)
    if path is None:
        return
    _delete(df.sparkSession, path)
    _written[:] = [(s, p) for s, p in _written if p != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit; its folder then goes with the application's
            break


def bound_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Keep Arrow batches small enough for rows that hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
