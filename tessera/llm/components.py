"""Connected components: one bounded task where the links are few, else alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._storage import materialize, release

#: Links that one task joins up (16 bytes each, and about ten times that while it works).
MOST_LINKS = 1 << 20


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of each node of the links."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while not ((further := root[root]) == root).all():
            root = further
    return nodes, nodes[root]


def _contracted(edges: DataFrame, whole: bool) -> DataFrame:
    """(node, component) by the links of each ``MOST_LINKS`` of a task, or of the one task there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            nodes, roots = contract(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ([], []))))
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "component"])

        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if not whole and sum(len(a) for a, _ in parts) >= MOST_LINKS:
                yield out()
        yield out()

    return edges.select("a", "b").mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component is the least node reachable.

    Self-loops and repeated edges are allowed; an empty edge list gives no row. Beyond ``most_links`` hubs are met by a pre-aggregated
    minimum that is joined back, never by a collected neighbour list, and every edge list is a written table.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    if edges.count() <= most_links:
        return materialize(_contracted(edges.repartition(1), True), "components")
    edges = materialize(_contracted(edges, False).where("component < node").select(F.col("component").alias("a"), F.col("node").alias("b")).distinct(), "edges")
    before = _digest(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("a").alias("b"), F.col("m").alias("a")).where("a < b").union(low.select("b", F.col("m").alias("a")))
        last, edges = edges, materialize(small.select("a", "b").distinct(), "edges")
        release(last)
        now = _digest(edges)
        if now == before:
            break
        before = now
    return materialize(edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a"), F.col("a"))).distinct(), "components")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
