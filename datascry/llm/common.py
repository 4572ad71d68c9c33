"""What the corpus operators share: row identity, cut lineage, free names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the setting ``spark.checkpoint.dir``, or
    the context's checkpoint folder.

    Without either only a local session, whose tasks run in the driver, gets a
    temporary folder; elsewhere each executor would write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="datascry-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder, in one of this application's own that
    goes with it when it ends."""
    home = f"{shared_dir(spark)}/datascry/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(home)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        store.mkdirs(where)
        store.deleteOnExit(where)
    return f"{home}/{what}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a path made by :func:`scratch` through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Deletes what :func:`cut` wrote for frames that nothing reads any more,
    and lets Spark drop the shuffle files of finished jobs: it does so once the
    driver's garbage is collected, which else may be half an hour away."""
    for df in done:
        drop_path(spark, df.scratch_path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts make large Arrow batches: lowers this session's limit on rows
    in one to :data:`BATCH_ROWS`, unless it is lower already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_key(text: Column) -> Column:
    """64-bit hash of a text; with the id it identifies a row (null text: 42)."""
    return F.xxhash64(text)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each prefixed until no column of ``df`` has it (case-blind)."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
