"""Tables written to the folder that the cluster shares, to cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []
#: Names of staged tables that the catalogue knows, by their paths.
_TABLES: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a fresh local one, if all work is on this machine (tests)."""
    sc = spark.sparkContext
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or sc.getConf().get(key) or getattr(sc, "_gazette_dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = sc._gazette_dir = "file://" + tempfile.mkdtemp(prefix="gazette-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_at_exit, spark)
    _STAGED.append(path)
    return path


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    writer = df.write if compression is None else df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def stage_bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """Write df to the shared folder in buckets of key, without a shuffle, and read it back; groups of key are then found without one."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = "gazette_" + path.rpartition("-")[2]
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    _TABLES[path] = table
    out = spark.table(table)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stage() that nothing reads any more, as those of earlier rounds of a loop."""
    for t in tables:
        path = getattr(t, "staged_at", None)
        if path in _STAGED:
            _STAGED.remove(path)
            _delete(t.sparkSession, [path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if table := _TABLES.pop(p, None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete what stage() has written in this process; results still to be read must be read before."""
    paths, _STAGED[:] = list(_STAGED), []
    _delete(spark, paths)


def _at_exit(spark: SparkSession) -> None:
    """What is still there when the program ends goes with it, if Spark still runs."""
    with contextlib.suppress(Exception):
        release(spark)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what one Arrow batch holds, so that very long texts do not fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
