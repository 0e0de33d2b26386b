"""The table of node states: chunks enter it with their territory, leave it, and get new territories with their dynamics kept.

Columns: id, territory, novelty, familiarity, mass, heat (raw), last_decay_tick, last_touch_tick, use_count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.activation import effective_heat
from tessera.functions.config import DynamicsConfig
from tessera.operators.territories import assign_in_order


def register(state: DataFrame, assigned: DataFrame, tick: int, *, cold: bool = False, config: DynamicsConfig = DynamicsConfig()) -> DataFrame:
    """``state`` with the chunks of ``assigned`` (id, territory, novelty) that it doesn't have yet: heat by novelty, none if cold."""
    new = assigned.join(state.select("id"), "id", "left_anti").dropDuplicates(["id"])
    heat = F.lit(0.0) if cold else F.lit(config.registration_gain) * F.col("novelty")
    now = F.lit(int(tick)).cast("long")
    rows = new.select("id", "territory", "novelty", F.lit(0.0).alias("familiarity"), F.lit(1.0).alias("mass"), heat.alias("heat"), now.alias("last_decay_tick"), now.alias("last_touch_tick"), F.lit(0).cast("long").alias("use_count"))
    return state.select(*rows.columns).unionByName(rows)


def remove(state: DataFrame, gone: DataFrame) -> DataFrame:
    """``state`` without the ids of ``gone`` (id)."""
    return state.join(gone.select("id").distinct(), "id", "left_anti")


def centroids_without(territories: DataFrame, chunks: DataFrame) -> DataFrame:
    """(territory, centroid, members) after chunks (territory, embedding) have left: the mean over those that stay, none of a
    territory nobody is left in. Ids are never given again, as nothing renumbers them."""
    flat = chunks.where(F.col("embedding").isNotNull()).select("territory", F.posexplode("embedding").alias("pos", "x"))
    lost = flat.groupBy("territory", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("k"))
    sums = lost.groupBy("territory").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda r: r["s"]).alias("lost"), F.max("k").alias("k"))
    left = F.col("members") - F.coalesce("k", F.lit(0))
    mean = F.when(F.col("lost").isNull(), F.col("centroid")).otherwise(F.zip_with("centroid", "lost", lambda c, s: (c * F.col("members") - s) / left))
    return territories.join(sums, "territory", "left").where(left > 0).select("territory", mean.alias("centroid"), left.alias("members"))


def rebuild(state: DataFrame, chunks: DataFrame, *, config: DynamicsConfig = DynamicsConfig()) -> DataFrame:
    """``state`` with territories assigned afresh from ``chunks`` (id, created_at, embedding) in order; all else is kept."""
    known = chunks.join(state.select("id"), "id", "left_semi")
    fresh = assign_in_order(known, config.territory_threshold, config.territory_members).select("id", F.col("territory").alias("__new__"))
    return state.join(fresh, "id", "left").withColumn("territory", F.coalesce("__new__", "territory")).drop("__new__")


def clean_template(chunks: DataFrame, *, config: DynamicsConfig = DynamicsConfig()) -> DataFrame:
    """All chunks registered cold in the order of their creation, at tick 0."""
    assigned = assign_in_order(chunks, config.territory_threshold, config.territory_members)
    nothing = chunks.sparkSession.createDataFrame([], "territory int, novelty double, familiarity double, mass double, heat double, last_decay_tick long, last_touch_tick long, use_count long")
    empty = assigned.select("id").limit(0).join(nothing)
    return register(empty, assigned, 0, cold=True, config=config)


def set_territory(chunks: DataFrame, moves: DataFrame) -> DataFrame:
    """``chunks`` with the territory that ``moves`` (id, territory) names."""
    return chunks.join(moves.select("id", F.col("territory").alias("__new__")), "id", "left").withColumn("territory", F.coalesce("__new__", "territory")).drop("__new__")


def with_effective(state: DataFrame, tick: int, config: DynamicsConfig = DynamicsConfig()) -> DataFrame:
    """``state`` with ``effective``: raw heat decayed by the ticks since it was last brought up to date."""
    return state.withColumn("effective", effective_heat(F.col("heat"), F.lit(int(tick)), F.col("last_decay_tick"), config.half_life))


def bounded_candidates(chunks: DataFrame, centroids: DataFrame, nearest: int = 3, cap: int = 200) -> DataFrame:
    """(source, target): for each chunk the newest older chunks of its ``nearest`` territories, the same quota from each; ``cap`` in all
    beside itself. Positions within a territory are joined, so a chunk meets its quota however large the territory is.

    The chunk itself is the newest of its own territory then and takes a place of that quota.
    """
    from tessera.functions.vectors import cosine

    own = chunks.where(F.col("embedding").isNotNull()).select("id", "created_at", "territory", "embedding")
    scored = own.join(F.broadcast(centroids.select(F.col("territory").alias("t"), "centroid"))).withColumn("s", F.round(cosine(F.col("embedding"), F.col("centroid")), 9))
    by_similarity = Window.partitionBy("id").orderBy(F.col("s").desc(), "t")
    near = scored.select("id", "created_at", "territory", "t", "s").withColumn("place", F.row_number().over(by_similarity)).where(F.col("place") <= nearest)
    quota = -(-(cap + 1) // nearest)
    members = own.select(F.col("territory").alias("t"), "created_at", "id", F.lit(1).alias("member"))
    asked = near.select("t", "created_at", "id", F.lit(0).alias("member"), (F.col("t") == F.col("territory")).alias("home"))
    order = Window.partitionBy("t").orderBy("created_at", "id", F.col("member").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counted = members.withColumn("home", F.lit(None).cast("boolean")).unionByName(asked).withColumn("upto", F.sum("member").over(order))
    ranked = counted.where("member = 1").select("t", F.col("upto").alias("rank"), F.col("id").alias("target"))
    wanted = counted.where("member = 0 and upto > 0").select("t", F.col("id").alias("source"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("upto") - quota + 1), F.col("upto"))).alias("rank"))
    return wanted.join(ranked, ["t", "rank"]).where("source <> target").select("source", "target")


def bounded_edges(chunks: DataFrame, centroids: DataFrame, threshold: float = 0.55, most: int = 6, nearest: int = 3, cap: int = 200) -> DataFrame:
    """(source, target, weight): each chunk's ``most`` most similar candidates at or over the threshold, ties by target descending. Only
    what a node sends out is limited, so hubs can form."""
    from tessera.functions.vectors import cosine

    side = lambda s: chunks.select(F.col("id").alias(s), F.col("embedding").alias(f"{s}_v"))
    pairs = bounded_candidates(chunks, centroids, nearest, cap).join(side("source"), "source").join(side("target"), "target")
    scored = pairs.select("source", "target", cosine(F.col("source_v"), F.col("target_v")).alias("weight")).where(F.col("weight") >= threshold)
    best = Window.partitionBy("source").orderBy(F.col("weight").desc(), F.col("target").desc())
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("source", "target", "weight")


def handles(nodes: DataFrame) -> DataFrame:
    """(id, handle): numbers from 0 in the order of ids. The count of each range of ids is taken first, so no task orders them all."""
    parts = nodes.select("id").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("id")
    within = Window.partitionBy("part").orderBy("id")
    ranked = parts.withColumn("k", F.row_number().over(within) - 1)
    sizes = ranked.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return ranked.join(F.broadcast(starts), "part").select("id", (F.col("first") + F.col("k")).cast("long").alias("handle"))
