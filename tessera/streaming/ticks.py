"""The organism's clock as a stream: each micro-batch of stimuli is one logical tick of the stored node states.

The state of tick n is a folder ``tick=n``. A batch reads the last one before its number, applies the stimuli, lets heat decay and spread,
and writes its own; run again after a failure it finds the same predecessor and writes the same rows, so time never moves twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.config import DynamicsConfig
from tessera.operators.dynamics import advance, apply_stimuli
from tessera.sources.sinks import replace_folder
from tessera.streaming.watch import drain


def state_before(spark: SparkSession, table: str, tick: int) -> DataFrame:
    """The newest state of a tick below ``tick``."""
    found = spark.read.parquet(table).where(F.col("tick") < tick)
    last = found.agg(F.max("tick")).first()[0]
    if last is None:
        raise ValueError(f"{table} has no state before tick {tick}")
    return found.where(F.col("tick") == last).drop("tick")


def start_state(state: DataFrame, table: str) -> None:
    """Store (id, familiarity, mass, heat, use_count) as the state before the first batch."""
    replace_folder(state, f"{table}/tick=-1", "parquet")


def one_tick(state: DataFrame, stimuli: DataFrame, nbrs: DataFrame, config: DynamicsConfig = DynamicsConfig()) -> DataFrame:
    """The state after the stimuli and a tick of decay and diffusion."""
    fed = apply_stimuli(state, stimuli)
    warm = advance(fed.select(F.col("id").alias("node"), "heat"), nbrs, half_life=float(config.half_life), fraction=config.diffusion, floor=config.floor)
    return fed.drop("heat").join(warm.withColumnRenamed("node", "id"), "id")


def run_ticks(spark: SparkSession, queue: str, table: str, nbrs: DataFrame, checkpoint: str, *, config: DynamicsConfig = DynamicsConfig(), most_files: int = 256, interval: str = "3 seconds", once: bool = False) -> StreamingQuery:
    """Drain the queue folder tick by tick into the state table. Stimuli of unknown ids change nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        state = state_before(batch.sparkSession, table, number)
        replace_folder(one_tick(state, batch, nbrs, config).select("id", "familiarity", "mass", "heat", "use_count"), f"{table}/tick={number}", "parquet")

    return drain(spark, queue, apply, checkpoint, most_files=most_files, interval=interval, once=once)
