"""Permutation nulls: one simulation, then identities relabelled per trial. Draws come from hashes, so runs and engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def permutations(nodes: DataFrame, trials: int, seed: int, strata: str | None = None) -> DataFrame:
    """(trial, node, identity): per trial the nodes of a stratum exchange identities; nodes marked ``fixed`` keep theirs."""
    by = ["trial", *([strata] if strata else [])]
    moving = nodes.where(~F.col("fixed")).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    placed = moving.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("node")))
    drawn = moving.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(draw(seed, F.col("trial"), F.col("node"))))).withColumnRenamed("node", "identity")
    return placed.join(drawn.select(*by, "k", "identity"), [*by, "k"]).select("trial", "node", "identity")


def null_fractions(auc: DataFrame, perms: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """(trial, by..., fraction): the foreign fraction under each relabelling; fixed nodes keep their class."""
    trials = perms.select("trial").distinct()
    own = auc.crossJoin(F.broadcast(trials))
    labelled = own.join(perms, ["trial", "node"], "left").withColumn("identity", F.coalesce("identity", "node"))
    seen = labelled.join(classes.select(F.col("node").alias("identity"), "class"), "identity", "left").withColumn("class", F.coalesce("class", F.lit("other")))
    sums = seen.groupBy("trial", *by).agg(*[F.sum(F.when(F.col("class") == c, F.col("auc")).otherwise(0.0)).alias(c) for c in ("related", "other")])
    return sums.select("trial", *by, F.when(F.col("related") + F.col("other") > 0, F.col("related") / (F.col("related") + F.col("other"))).alias("fraction"))


def movable_fraction(nodes: DataFrame) -> DataFrame:
    """The share of nodes in degree strata that hold both labels."""
    strata = nodes.groupBy("degree").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))
    return strata.agg((F.sum(F.when(F.col("labels") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("movable"))


def omnibus(real: DataFrame, calibration: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Medians and 95th percentiles per target from the calibration draws; an independent stream gives the null of the median
    difference and of the number of targets over their percentile."""
    limits = calibration.groupBy("target").agg(F.median("fraction").alias("mid"), F.percentile("fraction", F.lit(0.95)).alias("q95"))
    marked = lambda df, by: df.join(limits, "target").groupBy(*by).agg(F.median(F.col("fraction") - F.col("mid")).alias("median_delta"), F.sum((F.col("fraction") > F.col("q95")).cast("long")).alias("passed"), F.max(F.col("fraction") - F.col("mid")).alias("max_delta"))
    observed = marked(real, []).select(*[F.col(c).alias(f"real_{c}") for c in ("median_delta", "passed", "max_delta")])
    null = marked(evaluation, ["trial"]).crossJoin(F.broadcast(observed))
    p = lambda c: ((1 + F.sum(F.when(F.col(c) >= F.col(f"real_{c}"), 1).otherwise(0))) / (1 + F.count("*"))).alias(f"p_{c}")
    names = ("median_delta", "passed", "max_delta")
    return null.groupBy(*[f"real_{c}" for c in names]).agg(*map(p, names))


def source_matrix(auc: DataFrame, sources: DataFrame) -> DataFrame:
    """(origin, destination, share): the median over an origin's targets of each destination's share of all foreign heat."""
    own = auc.join(sources.select(F.col("node").alias("target"), F.col("source").alias("origin")), "target").join(sources.select("node", F.col("source").alias("destination")), "node").where("origin <> destination")
    sums = own.groupBy("target", "origin", "destination").agg(F.sum("auc").alias("heat"))
    shares = sums.withColumn("share", F.when(F.sum("heat").over(Window.partitionBy("target")) > 0, F.col("heat") / F.sum("heat").over(Window.partitionBy("target"))))
    return shares.groupBy("origin", "destination").agg(F.median("share").alias("share"), F.count("*").alias("targets"))


def matched_prefix(paths: DataFrame) -> DataFrame:
    """Paths (trial, arm, step, ...) cut to the shortest arm of their trial."""
    longest = paths.groupBy("trial", "arm").agg(F.max("step").alias("n"))
    return paths.join(longest.groupBy("trial").agg(F.min("n").alias("n")), "trial").where("step <= n").drop("n")


def uniform(seed: int, *parts: Column) -> Column:
    return F.conv(F.substring(draw(seed, *parts), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def choice_trials(deltas: DataFrame, trials: int, seed: int, gamma: float = 1.0, tau: float = 1.0) -> DataFrame:
    """(delta, predicted, observed): how often a softmax walker takes the warmer of two forks, against its law."""
    from tessera.functions.activation import choice_probability

    drawn = deltas.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("p", choice_probability(F.col("delta"), gamma, tau))
    return drawn.groupBy("delta").agg(F.max("p").alias("predicted"), F.avg((uniform(seed, F.col("trial"), F.round(F.col("delta") * 10).cast("int")) < F.col("p")).cast("double")).alias("observed"))


def top_destination(auc: DataFrame, sources: DataFrame) -> DataFrame:
    """Per target: the source that gathers most heat among those that aren't its own, ties by the greater name."""
    own = auc.join(sources.select(F.col("node").alias("target"), F.col("source").alias("origin")), "target").join(sources, "node").where("origin <> source")
    return hottest(own.groupBy("target", "source").agg(F.sum("auc").alias("heat")))


def hottest(heat: DataFrame) -> DataFrame:
    """(target, destination, heat) of (target, source, heat): each target's source of most heat, ties by the greater name."""
    return heat.groupBy("target").agg(F.max_by("source", F.struct(F.round("heat", 9), "source")).alias("destination"), F.max(F.round("heat", 9)).alias("heat"))


def arm_means(paths: DataFrame, value: str) -> DataFrame:
    """Per trial the mean of ``value`` by arm over matched prefixes, and the difference of the first arm from the second."""
    means = matched_prefix(paths).groupBy("trial", "arm").agg(F.avg(value).alias("m"))
    pair = means.groupBy("trial").agg(F.min_by("m", "arm").alias("first"), F.max_by("m", "arm").alias("second"), F.count("*").alias("arms")).where("arms > 1")
    return pair.select("trial", "first", "second", (F.col("first") - F.col("second")).alias("delta"))
