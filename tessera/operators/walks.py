"""Bounded softmax walks over the neighbour graph, and the gates that read their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.permutation import uniform


def softmax_walks(nbrs: DataFrame, scores: DataFrame, starts: DataFrame, steps: int, seed: int, gamma: float = 1.0, tau: float = 1.0) -> DataFrame:
    """(walk, step, node): from each start (walk, node), ``steps`` hops to a neighbour drawn with weight exp(gamma * score / tau)
    (unknown nodes score 0), by a hash draw per walk and step. All walks take a step together, as one join."""
    weights = nbrs.join(scores.select(F.col("node").alias("neighbour"), "score"), "neighbour", "left").select("node", "neighbour", F.exp(F.lit(gamma / tau) * F.coalesce("score", F.lit(0.0))).alias("w"))
    by = Window.partitionBy("node").orderBy("neighbour")
    upto = weights.withColumn("hi", F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(Window.partitionBy("node")))
    ranges = upto.select("node", "neighbour", ((F.col("hi") - F.col("w")) / F.col("all")).alias("lo"), F.when(F.row_number().over(Window.partitionBy("node").orderBy(F.col("neighbour").desc())) == 1, 2.0).otherwise(F.col("hi") / F.col("all")).alias("hi"))
    at = starts.select("walk", F.lit(0).alias("step"), "node")
    path = [at]
    for k in range(1, steps + 1):
        drawn = at.select("walk", "node", uniform(seed, F.col("walk"), F.lit(k)).alias("u"))
        at = drawn.join(ranges, "node").where("u >= lo and u < hi").select("walk", F.lit(k).alias("step"), F.col("neighbour").alias("node"))
        path.append(at)
    return reduce(DataFrame.union, path)


def gates(results: DataFrame, rules: dict[str, tuple[str, str, float]]) -> DataFrame:
    """(gate, value, passed) for preregistered rules gate -> (metric, '<=' or '>=' or '>', limit) over (metric, value); a
    metric that isn't there fails its gate. A last row, 'all', passes if all do."""
    test = {"<=": lambda v, x: v <= x, ">=": lambda v, x: v >= x, ">": lambda v, x: v > x}
    one = results.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(g) for g, (m, _, _) in rules.items()])
    rows = [F.struct(F.lit(g).alias("gate"), F.col(g).alias("value"), F.coalesce(test[op](F.col(g), F.lit(x)), F.lit(False)).alias("passed")) for g, (_, op, x) in rules.items()]
    every = reduce(lambda a, b: a & b, [r["passed"] for r in rows])
    total = F.struct(F.lit("all").alias("gate"), F.lit(None).cast("double").alias("value"), every.alias("passed"))
    return one.select(F.explode(F.array(*rows, total)).alias("r")).select("r.*")
