"""Keyed table mutations over immutable Parquet: upserts, provenance, replacement of a source, cascades, snapshots and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By id: an existing chunk keeps its source and created_at and takes the other columns of the newest incoming one."""
    newest = Window.partitionBy("id").orderBy(F.col("created_at").desc())
    incoming = incoming.withColumn("__k__", F.row_number().over(newest)).where("__k__ = 1").drop("__k__")
    old = existing.select("id", F.col("source").alias("__s__"), F.col("created_at").alias("__c__"))
    updated = incoming.join(old, "id", "left").withColumn("source", F.coalesce("__s__", "source")).withColumn("created_at", F.coalesce("__c__", "created_at")).select(*existing.columns)
    return existing.join(incoming.select("id"), "id", "left_anti").select(*existing.columns).unionByName(updated)


def attach(provenance: DataFrame, incoming: DataFrame) -> DataFrame:
    return provenance.unionByName(incoming).dropDuplicates(["chunk_id", "source"])


def sync_source(provenance: DataFrame, source: str, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(provenance without the source's stale chunks, chunks that no source holds any more)."""
    own = provenance.where(F.col("source") == source)
    stale = own.join(current.select("chunk_id"), "chunk_id", "left_anti")
    left = provenance.join(stale, ["chunk_id", "source"], "left_anti")
    return left, stale.select("chunk_id").distinct().join(left, "chunk_id", "left_anti")


def cascade_delete(gone: DataFrame, chunks: DataFrame, provenance: DataFrame, edges: DataFrame, stimuli: DataFrame) -> dict[str, DataFrame]:
    """The tables without the chunks of ``gone`` (chunk_id)."""
    anti = lambda df, c: df.join(gone.select(F.col("chunk_id").alias(c)), c, "left_anti")
    return {"chunks": anti(chunks, "id"), "provenance": anti(provenance, "chunk_id"), "edges": anti(anti(edges, "source"), "target"), "stimuli": anti(stimuli, "chunk_id")}


def chunks_of(documents: DataFrame, most: int = 1500, least: int = 80) -> DataFrame:
    """(chunk_id, text, source, index) of each document (source, text): content-addressed, order within the document kept."""
    from tessera.functions.text import chunk_id, chunks

    cut = documents.select("source", F.posexplode(chunks(F.col("text"), most, least)).alias("index", "text"))
    return cut.select(chunk_id(F.col("text")).alias("chunk_id"), "text", "source", F.col("index").cast("long"))


def sources_per_chunk(provenance: DataFrame) -> DataFrame:
    return provenance.groupBy("chunk_id").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def membership_digest(provenance: DataFrame) -> DataFrame:
    """Per source: its chunk count and the sha256 of its sorted ids, one a line. Ids of a source meet in one aggregate."""
    ids = F.array_join(F.sort_array(F.collect_set("chunk_id")), "\n")
    return provenance.groupBy("source").agg(F.countDistinct("chunk_id").alias("chunks"), F.sha2(ids, 256).alias("digest"))


def overlap(provenance: DataFrame, groups: DataFrame) -> DataFrame:
    """Chunks that belong to more than one group of sources (source, group): empty if the groups are apart."""
    return provenance.join(groups, "source").groupBy("chunk_id").agg(F.countDistinct("group").alias("groups")).where("groups > 1")


def recent(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n)


def by_ids(df: DataFrame, ids: list, id: str = "id") -> DataFrame:
    """Rows by id in the given order."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), f"pos long, {id} {df.schema[id].dataType.simpleString()}")
    return df.join(F.broadcast(wanted), id).orderBy("pos")
