"""Shared folder, lineage cuts and table access used by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the setting is missing and Spark runs on this machine alone (tests, a laptop) is a local folder made and
    kept for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_tables: list[str] = []  # folders that stages of a pipeline have written for themselves and that are still there
_in_stage = False
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a stage's Python workers get at once. A batch of texts stands in the JVM and twice in a worker, for each core
#: of an executor; Spark's 10,000 rows of a few kB are some 50 MB each time.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later reads neither recompute it nor depend on an executor.

    Nothing reads the shuffles of a table once it is written, so Spark is asked to free their files then and not when
    the driver happens to collect garbage."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
        if _in_stage:
            _tables.append(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    return {name.rpartition("/")[0] for name in df.inputFiles()}


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote for ``df``, once nothing reads it any more."""
    for folder in _folders(df):
        _delete(df.sparkSession, folder)
        _tables[:] = [t for t in _tables if t.rpartition("/")[2] != folder.rpartition("/")[2]]


def release(docs: DataFrame) -> None:
    """Delete what stages have written for themselves, but for what ``docs`` reads. From then on shuffles are freed when
    the query that made them ends, and Python workers get ``BATCH_ROWS`` rows at once at most."""
    spark, kept = docs.sparkSession, {f.rpartition("/")[2] for f in _folders(docs)}
    spark.conf.set(FREE_SHUFFLES, "true")
    rows = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    for folder in [t for t in _tables if t.rpartition("/")[2] not in kept]:
        _delete(spark, folder)
        _tables.remove(folder)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidy(stage: Stage) -> Stage:
    """A stage that begins by deleting what the stages before it wrote for themselves, as their rows are written by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _in_stage
        release(docs)
        _in_stage = True
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _in_stage = False

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
