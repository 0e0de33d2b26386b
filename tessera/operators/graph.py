"""The sparse similarity graph: edges by territory, neighbour views, searches and diagnostics, all as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import most_similar

OUT_DEGREE, NEIGHBOURS = 6, 12
#: Chunks of a territory that are compared with as many at a time.
BLOCK = 2048


def similarity_edges(chunks: DataFrame, threshold: float = 0.55, most: int = OUT_DEGREE, territory: str = "territory") -> DataFrame:
    """(source, target, weight): a chunk's ``most`` most similar chunks of its territory at or over the threshold, ties by
    target descending. All pairs of a territory are compared, two blocks of its chunks at a time, so the work grows with the square
    of a territory and rows only with its blocks. ``registry.bounded_edges`` compares a fixed number of candidates whatever the
    territories' sizes."""
    rows = chunks.select(F.col(territory).alias("territory"), "id", "embedding").where("territory is not null and id is not null and embedding is not null")
    sizes = rows.groupBy("territory").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(sizes), "territory").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).drop("blocks")
    kind = rows.schema["id"].dataType.simpleString()
    against = dealt.toDF("t", "id", "embedding", "b", "a")
    compared = dealt.groupBy("territory", "own", "other").cogroup(against.groupBy("t", "a", "b")).applyInArrow(most_similar(threshold, most), f"source {kind}, target {kind}, weight double")
    best = Window.partitionBy("source").orderBy(F.col("weight").desc(), F.col("target").desc())
    return compared.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("source", "target", "weight")


def room_left(edges: DataFrame, existing: DataFrame, most: int = OUT_DEGREE) -> DataFrame:
    """Of new ``edges`` each source's heaviest, as many as ``existing`` edges leave of its ``most``; ties by target descending."""
    used = existing.groupBy("source").agg(F.count("*").alias("used"))
    best = Window.partitionBy("source").orderBy(F.col("weight").desc(), F.col("target").desc())
    ranked = edges.withColumn("rank", F.row_number().over(best)).join(used, "source", "left")
    return ranked.where(F.col("rank") + F.coalesce("used", F.lit(0)) <= most).select(*edges.columns)


def clean_edges(edges: DataFrame) -> DataFrame:
    """No self-loops, the heavier of repeated edges."""
    return edges.where("source <> target").groupBy("source", "target").agg(F.max("weight").alias("weight"))


def last_edges(edges: DataFrame) -> DataFrame:
    """Upsert by key: the weight written last wins."""
    return edges.groupBy("source", "target", "relation").agg(F.max_by("weight", "created_at").alias("weight"), F.max("created_at").alias("created_at"))


def neighbours(edges: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """(node, neighbour, weight): both directions, the heavier of two edges, the ``most`` heaviest, ties by neighbour."""
    way = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("neighbour"), "weight")
    both = edges.select(F.inline(F.array(way("source", "target"), way("target", "source"))))
    merged = both.groupBy("node", "neighbour").agg(F.max("weight").alias("weight"))
    best = Window.partitionBy("node").orderBy(F.col("weight").desc(), "neighbour")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).drop("rank")


def degrees(nbrs: DataFrame) -> DataFrame:
    return nbrs.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def hops(nbrs: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(node, hops): breadth-first from ``seeds`` (node), at most ``most`` steps; each step joins the frontier alone."""
    reached = seeds.select("node").distinct().withColumn("hops", F.lit(0).cast("long"))
    frontier = reached
    for k in range(1, most + 1):
        step = frontier.join(nbrs, "node").select(F.col("neighbour").alias("node")).distinct()
        frontier = step.join(reached, "node", "left_anti").withColumn("hops", F.lit(k).cast("long"))
        reached = reached.union(frontier)
    return reached


def expand(nbrs: DataFrame, seeds: DataFrame, steps: int = 1, most: int = 128) -> DataFrame:
    """The nodes within ``steps`` of the seeds, seeds left out, the first ``most`` by hops, then weight, then id."""
    near = hops(nbrs, seeds, steps).where("hops > 0")
    best = nbrs.groupBy(F.col("neighbour").alias("node")).agg(F.max("weight").alias("weight"))
    return near.join(best, "node").orderBy("hops", F.col("weight").desc(), "node").limit(most).select("node", "hops")


def profile(nbrs: DataFrame, classes: DataFrame) -> DataFrame:
    """Per node: direct neighbours and weights by class (origin, related, other)."""
    seen = nbrs.join(classes.select(F.col("node").alias("neighbour"), "class"), "neighbour", "left")
    of = lambda c: (F.coalesce("class", F.lit("other")) == c)
    aggs = [x for c in ("origin", "related", "other") for x in (F.sum(of(c).cast("long")).alias(f"n_{c}"), F.sum(F.when(of(c), F.col("weight")).otherwise(0.0)).alias(f"w_{c}"))]
    return seen.groupBy("node").agg(*aggs)


def bridges(nbrs: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class: the node with the greatest weight into other classes (ties by total weight, then greatest id)."""
    own = nbrs.join(classes, "node").join(classes.select(F.col("node").alias("neighbour"), F.col("class").alias("other")), "neighbour")
    scored = own.groupBy("class", "node").agg(F.sum(F.when(F.col("class") != F.col("other"), F.col("weight")).otherwise(0.0)).alias("foreign_weight"), F.sum("weight").alias("total_weight"))
    return scored.groupBy("class").agg(F.max_by("node", F.struct(F.round("foreign_weight", 9), F.round("total_weight", 9), "node")).alias("bridge"), F.max(F.round("foreign_weight", 9)).alias("foreign_weight"))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that touch a node of ``gone`` (node), at either end."""
    out = edges.join(gone.select(F.col("node").alias("source")), "source", "left_anti")
    return out.join(gone.select(F.col("node").alias("target")), "target", "left_anti")


def edge_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    key = ["source", "target"]
    marked = a.select(*key).distinct().withColumn("a", F.lit(1)).join(b.select(*key).distinct().withColumn("b", F.lit(1)), key, "full")
    return marked.agg((F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)) / F.count("*")).alias("jaccard"))


def weight_error(a: DataFrame, b: DataFrame) -> DataFrame:
    key = ["source", "target"]
    return a.join(b.withColumnRenamed("weight", "other"), key).agg(F.max(F.abs(F.col("weight") - F.col("other"))).alias("max_error"), F.count("*").alias("common"))


def flat(nbrs: DataFrame) -> DataFrame:
    return nbrs.withColumn("weight", F.lit(1.0))


def lesion(nbrs: DataFrame, target: DataFrame, related: DataFrame) -> DataFrame:
    """Neighbours without the links between target nodes and related nodes, either way."""
    t, r = target.select(F.col("node").alias("t")), related.select(F.col("node").alias("r"))
    marked = nbrs.join(t, nbrs["node"] == t["t"], "left").join(r, nbrs["neighbour"] == r["r"], "left").where("t is null or r is null").drop("t", "r")
    return marked.join(t, marked["neighbour"] == t["t"], "left").join(r, marked["node"] == r["r"], "left").where("t is null or r is null").drop("t", "r")


def component(nbrs: DataFrame, seed: DataFrame, checkpoint=None) -> DataFrame:
    """(node): all that the seed (node) reaches, step by step until nothing is new; each step joins the frontier alone."""
    reached = frontier = seed.select("node").distinct()
    while not frontier.isEmpty():
        step = frontier.join(nbrs, "node").select(F.col("neighbour").alias("node")).distinct()
        frontier = step.join(reached, "node", "left_anti")
        frontier = checkpoint(frontier) if checkpoint else frontier.persist()
        reached = reached.union(frontier)
    return reached


def component_classes(nbrs: DataFrame, seed: DataFrame, classes: DataFrame, checkpoint=None) -> DataFrame:
    """(class, nodes) over the seed's component; unknown nodes are other."""
    seen = component(nbrs, seed, checkpoint).join(classes, "node", "left")
    return seen.groupBy(F.coalesce("class", F.lit("other")).alias("class")).agg(F.count("*").alias("nodes"))
