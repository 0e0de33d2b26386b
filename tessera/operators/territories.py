"""Territories: exact online assignment, centroids, pruning and fair candidate scans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine


def assign_in_order(chunks: DataFrame, threshold: float = 0.55, most: int = 256, by: list[str] | None = None) -> DataFrame:
    """(by..., id, territory, novelty): online clustering in order of (created_at, id), which is sequential by definition.

    Independent corpora (``by``) run in parallel; within one, each vector meets all centroids in one matrix product. The
    nearest territory with room at or over the threshold takes it, the first made on ties; else it founds one.
    """
    keys = by or []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["created_at", "id"], kind="stable")
        sums: np.ndarray = np.zeros((0, 0))
        counts = np.zeros(0, np.int64)
        territory, novel = [], []
        for v in pdf["embedding"]:
            v = np.asarray(v, np.float64)
            norm = np.sqrt((v * v).sum())
            v = v / norm if norm else v
            if not len(counts):
                sums, counts = v[None, :].copy(), np.ones(1, np.int64)
                territory.append(0)
                novel.append(1.0)
                continue
            norms = np.sqrt((sums * sums).sum(1) * (v * v).sum())
            sims = np.divide(sums @ v, norms, out=np.zeros(len(sums)), where=norms > 0)
            novel.append(float(np.clip(1 - np.clip(sims.max(), -1, 1), 0, 1)))
            open_ = np.where(counts < most, sims, -2.0)
            k = int(open_.argmax())
            if open_[k] >= threshold:
                sums[k] += v
                counts[k] += 1
            else:
                k = len(counts)
                sums, counts = np.vstack([sums, v]), np.append(counts, 1)
            territory.append(k)
        return pdf[[*keys, "id"]].assign(territory=territory, novelty=novel)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.select(*keys, "id").schema)
    grouped = chunks if keys else chunks.withColumn("__all__", F.lit(0))
    return grouped.groupBy(*(keys or ["__all__"])).applyInPandas(run, f"{kinds}, territory int, novelty double")


def centroids(chunks: DataFrame) -> DataFrame:
    """(territory, centroid, members): the mean by position, aggregated map-side."""
    flat = chunks.where(F.col("embedding").isNotNull()).select("territory", F.posexplode("embedding").alias("pos", "x"))
    means = flat.groupBy("territory", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("members"))
    return means.groupBy("territory").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"), F.max("members").alias("members"))


def nearest(territories: DataFrame, query: DataFrame, k: int = 3, most: int = 1 << 14) -> DataFrame:
    """The ``k`` territories nearest to each query (query_id, vector). The side of fewer than ``most`` rows is broadcast, the territories
    if both are; one of them must be."""
    sides = [territories, query]
    small = next((i for i, df in enumerate(sides) if df.limit(most + 1).count() <= most), None)
    if small is None:
        raise ValueError(f"over {most} territories and queries: ask in blocks")
    scored = sides[1 - small].crossJoin(F.broadcast(sides[small])).withColumn("similarity", cosine(F.col("vector"), F.col("centroid")))
    best = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "territory")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "territory", "similarity", "rank")


def candidates(chunks: DataFrame, chosen: list[int], cap: int) -> DataFrame:
    """At most ``cap`` chunks of the chosen territories in their order, newest first, with the same quota for each; the newest
    ``cap`` of all where none is chosen."""
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    chosen = list(dict.fromkeys(chosen))
    if not chosen:
        return chunks.orderBy(*newest).limit(cap)
    place = F.array_position(F.array(*map(F.lit, chosen)), F.col("territory"))
    own = chunks.where(F.col("territory").isin(*chosen)).withColumn("place", place)
    quota = -(-cap // len(chosen))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("territory").orderBy(*newest))).where(F.col("rank") <= quota)
    return ranked.orderBy("place", "rank").limit(cap).drop("place", "rank")


def retrieve(chunks: DataFrame, state: DataFrame, vector: DataFrame, k: int, weight: float = 0.05) -> DataFrame:
    """The ``k`` best chunks for one vector (vector): similarity with a small share of the state score, ties by id."""
    from tessera.functions.activation import retrieval_score, state_score

    scored = chunks.where(F.col("embedding").isNotNull()).join(state, "id", "left").crossJoin(F.broadcast(vector))
    scored = scored.withColumn("similarity", cosine(F.col("vector"), F.col("embedding"))).withColumn("score", retrieval_score(F.col("similarity"), state_score(F.col("mass"), F.col("familiarity"), F.col("heat")), weight))
    return scored.orderBy(F.round("score", 9).desc(), "id").limit(k).select("id", "similarity", "score")


