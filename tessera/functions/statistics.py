"""Permutation statistics as grouped aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def p_right(null: Column, real: Column) -> Column:
    return (1 + F.sum(F.when(null >= real, 1).otherwise(0))) / (1 + F.count(null))


def p_left(null: Column, real: Column) -> Column:
    return (1 + F.sum(F.when(null <= real, 1).otherwise(0))) / (1 + F.count(null))


def p_two_sided(null: Column, real: Column) -> Column:
    return F.least(F.lit(1.0), 2 * F.least(p_right(null, real), p_left(null, real)))


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite, so that aggregates leave it out."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def finite_mean(x: Column) -> Column:
    return F.avg(finite(x))


def finite_median(x: Column) -> Column:
    return F.median(finite(x))


def null_summary(df: DataFrame, by: list[str], null: str = "null_value", real: str = "real_value") -> DataFrame:
    """Per group: the real value against its null draws; effect is null where the null median is 0."""
    real_value = F.max(real)
    out = df.groupBy(*by).agg(real_value.alias("real_value"), F.median(null).alias("null_median"), F.percentile(null, F.lit(0.05)).alias("null_q05"), F.percentile(null, F.lit(0.95)).alias("null_q95"), p_right(F.col(null), F.col(real)).alias("p_right"), p_left(F.col(null), F.col(real)).alias("p_left"))
    return out.withColumn("delta", F.col("real_value") - F.col("null_median")).withColumn("effect", F.when(F.col("null_median") != 0, F.col("real_value") / F.col("null_median"))).withColumn("p_two_sided", F.least(F.lit(1.0), 2 * F.least("p_right", "p_left")))


def benjamini_hochberg(df: DataFrame, p: str, id: str, by: list[str] | None = None) -> DataFrame:
    """Step-up adjusted values in ``q_bh``; null p-values pass through and don't count."""
    known = F.col(p).isNotNull()
    family = Window.partitionBy(*(by or []), known)
    scaled = F.col(p) * F.count(p).over(family) / F.row_number().over(family.orderBy(p, id))
    down = family.orderBy(F.col(p).desc(), F.col(id).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__scaled__", scaled).withColumn("q_bh", F.when(known, F.least(F.lit(1.0), F.min("__scaled__").over(down)))).drop("__scaled__")


def holm(df: DataFrame, p: str, id: str, by: list[str] | None = None) -> DataFrame:
    """Step-down adjusted values in ``p_holm``; null p-values pass through and don't count."""
    known = F.col(p).isNotNull()
    family = Window.partitionBy(*(by or []), known)
    scaled = F.col(p) * (F.count(p).over(family) - F.row_number().over(family.orderBy(p, id)) + 1)
    up = family.orderBy(p, id).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__scaled__", scaled).withColumn("p_holm", F.when(known, F.least(F.lit(1.0), F.max("__scaled__").over(up)))).drop("__scaled__")


def average_rank(column: str, by: list[str]) -> Column:
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation per group; null with under two rows or without variance."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__x__": average_rank(x, by), "__y__": average_rank(y, by)})
    spread = F.nullif(F.stddev_pop("__x__") * F.stddev_pop("__y__"), F.lit(0.0))
    return ranked.groupBy(*by).agg((F.covar_pop("__x__", "__y__") / spread).alias("rho"), F.count("*").alias("n"))


def sign_flip_test(df: DataFrame, value: str, id: str, trials: int, seed: int) -> DataFrame:
    """One-sided test of a median above 0: the sign of a row in a trial is a bit of a hash, so runs agree."""
    drawn = df.where(F.col(value).isNotNull()).select(id, value).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    bit = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"), F.col(id).cast("string")), 256), 1, 1)
    medians = drawn.groupBy("trial").agg(F.median(F.when(bit < "8", F.col(value)).otherwise(-F.col(value))).alias("m"))
    real = df.agg(F.median(value).alias("real_median"))
    return medians.crossJoin(F.broadcast(real)).groupBy("real_median").agg(((1 + F.sum(F.when(F.col("m") >= F.col("real_median"), 1).otherwise(0))) / (1 + F.count("*"))).alias("p"), F.count("*").alias("trials"))
