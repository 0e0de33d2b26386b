"""Shared scratch tables: every intermediate result that outlives a stage is a Parquet table in the cluster's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_run_dirs: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary folder only where driver and executors are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.gettempdir()


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in ``scratch_dir``; it goes when the application ends."""
    name = spark.sparkContext.applicationId
    if name not in _run_dirs:
        path = f"{scratch_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:8]}"
        files, where = _file_system(spark, path)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _run_dirs[name] = path
    return _run_dirs[name]


def materialize(df: DataFrame, label: str, arrow_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends there and a lost executor loses nothing.

    The shuffle files behind it are given back at once, as nothing reads them again. ``arrow_rows`` bounds the rows that go to
    Python at a time where they are large.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    settings = {_CLEANUP: "true"} | ({_ARROW_ROWS: str(arrow_rows)} if arrow_rows else {})
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later step reads."""
    for df in tables:
        files, where = _file_system(df.sparkSession, df.table_path)
        files.delete(where, True)
