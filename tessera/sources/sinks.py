"""Report and table sinks. A folder is written beside the old one and takes its place in one rename, so a reader sees either whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"json": ("json", {}), "csv": ("csv", {"header": "true"}), "csv.gz": ("csv", {"header": "true", "compression": "gzip"}), "tsv": ("csv", {"header": "true", "sep": "\t"}), "parquet": ("parquet", {})}
EDGE_LIST = "source string, target string, weight double"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def replace_folder(df: DataFrame, path: str, source: str, **options: str) -> None:
    """Write ``df`` in place of the folder ``path``; if writing fails, what was there stays."""
    spark, side = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.format(source).options(**options).save(side)
    files, new = _files(spark, side)
    _, old = _files(spark, path)
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{side} could not take the place of {path}")


def write_report(df: DataFrame, path: str, kind: str = "csv", files: int | None = None) -> None:
    """Write ``df`` to the folder ``path`` in place of what is there; ``files`` bounds the number of parts."""
    source, options = FORMATS[kind]
    replace_folder(df.coalesce(files) if files else df, path, source, **options)


def save_edges(edges: DataFrame, path: str) -> None:
    """The edge list as tab-separated text: source, target, weight."""
    write_report(edges.select(*[F.col(c).cast("string").alias(c) for c in ("source", "target")], F.col("weight").cast("double")), path, "tsv")


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """An edge list, without self-loops, the heavier of repeated edges; a malformed row fails the read."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=EDGE_LIST, mode="FAILFAST")
    return rows.where("source <> target").groupBy("source", "target").agg(F.max("weight").alias("weight"))
