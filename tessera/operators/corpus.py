"""Frozen corpora: loading with integrity checks, source selection, snapshots, replay and status."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOT_VERSION = 3


@dataclass(frozen=True)
class FrozenCorpus:
    chunks: DataFrame
    provenance: DataFrame
    edges: DataFrame


def load_frozen(spark: SparkSession, folder: str) -> FrozenCorpus:
    """The tables of a frozen corpus; raises if vectors differ in length, an edge dangles or a chunk has no source."""
    chunks, provenance, edges = (spark.read.parquet(f"{folder}/{t}") for t in ("chunks", "provenance", "edges"))
    report = integrity(chunks, provenance, edges).first()
    faults = [f"{name}: {report[name]}" for name in ("dangling_edges", "chunks_without_source") if report[name]]
    if report["dimensions"] > 1:
        faults.append(f"{report['dimensions']} vector lengths")
    if faults:
        raise ValueError("frozen corpus: " + "; ".join(faults))
    return FrozenCorpus(chunks, provenance, edges)


def integrity(chunks: DataFrame, provenance: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: chunks, edges, vector lengths, dangling edges, chunks without a source."""
    ids = chunks.select("id")
    ends = edges.select(F.col("source").alias("id")).unionAll(edges.select(F.col("target").alias("id")))
    out = chunks.agg(F.count("*").alias("chunks"), F.countDistinct(F.size("embedding")).alias("dimensions"))
    for name, df in (("edges", edges), ("dangling_edges", ends.join(ids, "id", "left_anti")), ("chunks_without_source", ids.join(provenance.select(F.col("chunk_id").alias("id")), "id", "left_anti"))):
        out = out.crossJoin(df.agg(F.count("*").alias(name)))
    return out


def freeze(corpus: FrozenCorpus, folder: str) -> dict[str, int]:
    """Write a corpus as versioned tables; the counts of its integrity report."""
    for name in ("chunks", "provenance", "edges"):
        getattr(corpus, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    return integrity(corpus.chunks, corpus.provenance, corpus.edges).first().asDict()


def resolve_source(provenance: DataFrame, wanted: str) -> str:
    """A source by its exact path, else by its file name if that is unique."""
    name = F.substring_index("source", "/", -1)
    found = [r.source for r in provenance.select("source").distinct().where((F.col("source") == wanted) | (name == wanted)).orderBy("source").limit(3).collect()]
    if wanted in found:
        return wanted
    if len(found) != 1:
        raise ValueError(f"source {wanted!r} is {'ambiguous' if found else 'missing'}")
    return found[0]


def order_confounded(chunks: DataFrame) -> DataFrame:
    """(source, first, last, confounded): whether the creation ranks of a source overlap no other source's, so that order and
    source can't be told apart."""
    ranked = chunks.withColumn("k", F.row_number().over(Window.orderBy("created_at", "id")) - 1)
    spans = ranked.groupBy("source").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    by = Window.orderBy("first", "last")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("first").over(by)
    return spans.withColumn("confounded", (F.coalesce(before, F.lit(-1)) < F.col("first")) & (F.coalesce(after, F.lit(2**31)) > F.col("last")))


def save_snapshot(state: DataFrame, territories: DataFrame, config: dict, tick: int, folder: str, half_life: float = 120.0) -> None:
    """Node states and territories of a tick as tables, config and version beside them. Where states carry the tick they were last
    brought up to, their heat is stored as of this tick."""
    if "last_decay_tick" in state.columns:
        from tessera.functions.activation import effective_heat

        now = F.lit(max(0, int(tick))).cast("long")
        state = state.withColumn("heat", effective_heat(F.col("heat"), now, F.col("last_decay_tick"), half_life)).withColumn("last_decay_tick", F.greatest("last_decay_tick", now))
    state.write.mode("overwrite").parquet(f"{folder}/state")
    territories.write.mode("overwrite").parquet(f"{folder}/territories")
    about = json.dumps({"version": SNAPSHOT_VERSION, "tick": max(0, int(tick)), "config": config})
    state.sparkSession.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")


def load_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict] | None:
    """(state, territories, about), or None where there is none; another version is refused."""
    from pyspark.errors import AnalysisException

    try:
        about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    except AnalysisException:
        return None
    if about["version"] != SNAPSHOT_VERSION:
        raise ValueError(f"snapshot version {about['version']}; {SNAPSHOT_VERSION} is needed")
    return spark.read.parquet(f"{folder}/state"), spark.read.parquet(f"{folder}/territories"), about


def status(chunks: DataFrame, edges: DataFrame, state: DataFrame, energy: DataFrame) -> DataFrame:
    """One row: counts, totals, and the last energy sample."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    out = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("territory").alias("territories"))
    parts = (edges.agg(F.count("*").alias("edges")), ends.agg(F.count("*").alias("connected")), state.agg(F.sum("heat").alias("total_heat"), F.sum((F.col("heat") > 0).cast("long")).alias("active"), F.avg("familiarity").alias("mean_familiarity"), F.avg("mass").alias("mean_mass")), energy.agg(F.max("tick").alias("tick"), F.max_by("energy", "tick").alias("energy"), F.max_by("settled", "tick").alias("settled")))
    for p in parts:
        out = out.crossJoin(p)
    return out


def full_status(chunks: DataFrame, edges: DataFrame, state: DataFrame, energy: DataFrame, stimuli: DataFrame, meta: DataFrame, *, runtime: dict | None = None, snapshot: dict | None = None, now: float = 0.0) -> DataFrame:
    """One row of everything a status page shows. ``meta`` (key, value) holds settings; the tick comes from the runtime record if its version fits, else
    from the snapshot, else from the last energy sample. A runtime record is fresh while the daemon runs and it is younger than
    three ticks (ten seconds at least)."""
    known = {r["key"]: r["value"] for r in meta.where(F.col("key").isin("daemon_state", "tick_interval_s", "watch_folder_path", "watch_folder_ok", "embedding_model", "embedding_dim")).collect()}
    usable = lambda d: bool(d) and int(d.get("version", 0)) == SNAPSHOT_VERSION
    source = "runtime" if usable(runtime) else "snapshot" if usable(snapshot) else None
    updated = float(runtime.get("updated_at", 0.0)) if source == "runtime" else None
    age = None if updated is None else max(0.0, now - updated)
    fresh = known.get("daemon_state") == "running" and age is not None and age <= max(10.0, 3 * float(known.get("tick_interval_s") or 3.0))
    flag = known.get("watch_folder_ok")
    out = status(chunks, edges, state, energy).crossJoin(stimuli.agg(F.count("*").alias("pending_stimuli")))
    tick = F.lit(int((runtime if source == "runtime" else snapshot)["tick"])) if source else F.coalesce("tick", F.lit(0))
    settled = F.lit(bool(runtime.get("settled"))) if source == "runtime" else F.coalesce("settled", F.lit(False))
    return out.withColumns({
        "tick": tick.cast("long"), "settled": settled, "status_source": F.lit(source) if source else F.when(F.col("chunks") > 0, "rebuild").otherwise("empty"),
        "status_updated_at": F.lit(updated).cast("double"), "runtime_age_s": F.lit(age).cast("double"), "runtime_fresh": F.lit(fresh), "daemon_state": F.lit(known.get("daemon_state") or "unknown"),
        "snapshot_tick": F.lit(int(snapshot["tick"]) if snapshot else None).cast("long"), "watch_folder_path": F.lit(known.get("watch_folder_path")), "watch_folder_ok": F.lit(None if flag is None else flag == "1").cast("boolean"),
        "embedding_model": F.lit(known.get("embedding_model")), "embedding_dim": F.lit(known.get("embedding_dim")).cast("int"),
    })


def replay_orders(chunks: DataFrame, orders: int, seed: int, *, threshold: float = 0.55, most: int = 6, probe: int = 3, cap: int = 200, room: int = 256, territory_threshold: float = 0.55) -> DataFrame:
    """(trial, source, target, weight): the graph that each of ``orders`` insertion orders builds, one task an order.

    Inserting is sequential within an order: a chunk finds its territory, then links with the most similar of the newest
    candidates of its nearest territories. Vectors are gathered per order, as a replay needs them all: for frozen samples of a
    few thousand chunks, which an order's task holds.
    """
    import numpy as np

    from tessera.operators.permutation import draw

    drawn = chunks.select("id", "embedding").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(orders - 1)))).withColumn("turn", draw(seed, F.col("trial"), F.col("id")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "id"], kind="stable")
        ids = pdf["id"].to_numpy()
        v = np.stack([np.asarray(x, np.float64) for x in pdf["embedding"]])
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        sums, members = [], []
        out = []
        for k in range(len(ids)):
            sims = np.array([s @ v[k] / max(np.sqrt(s @ s), 1e-12) for s in sums]) if sums else np.zeros(0)
            open_ = np.where([len(m) < room for m in members], sims, -2.0) if sums else sims
            if len(open_) and open_.max() >= territory_threshold:
                t = int(open_.argmax())
                sums[t] = sums[t] + v[k]
            else:
                t = len(sums)
                sums.append(v[k].copy())
                members.append([])
            members[t].append(k)
            sims = np.array([s @ v[k] / max(np.sqrt(s @ s), 1e-12) for s in sums])
            near = np.argsort(-sims, kind="stable")[:probe]
            quota = -(-(cap + 1) // len(near))
            pool = [j for n in near for j in members[n][::-1][:quota]][: cap + 1]
            pool = np.array([j for j in pool if j != k], np.int64)
            if len(pool):
                w = v[pool] @ v[k]
                best = sorted(((x, ids[j]) for x, j in zip(w, pool, strict=True) if x >= threshold), reverse=True)[:most]
                out += [(int(pdf["trial"].iloc[0]), ids[k], j, float(x)) for x, j in best]
        return pd.DataFrame(out, columns=["trial", "source", "target", "weight"])

    kind = chunks.schema["id"].dataType.simpleString()
    return drawn.groupBy("trial").applyInPandas(run, f"trial int, source {kind}, target {kind}, weight double")
