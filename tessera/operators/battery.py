"""The routing battery: heat pulses with a first-in-first-out work budget, their totals, and permutation nulls of where they go.

A pulse is sequential by definition (which nodes a tick works on depends on the order in which earlier ticks woke them), so one task
runs a target from its first tick to the last, as array operations over the part of the packed graph that it is linked with, and targets
run in parallel. The packed graph is sent to the tasks up to ``MOST_EDGES`` neighbour entries (12 bytes each); larger graphs are for ``dynamics.heat_auc``, whose ticks
are joins. Nulls relabel a run instead of repeating it; draws follow from seed, stream and trial alone, so every task draws the
same ones and reruns agree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.config import DynamicsConfig
from tessera.functions.statistics import benjamini_hochberg, holm

MOST_EDGES = 1 << 23
ORIGIN, RELATED, OTHER = 0, 1, 2
_DRAWN, _DEALT = 1 << 22, 1 << 21
#: Bytes of a row that are looked up at a time: their part of the table and the places stay in the cache.
_BYTES = 64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).T.astype(float)


def stable_seed(seed: int, name: str) -> int:
    return int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:16], 16)


class PackedGraph:
    """Node ids in order, and each node's neighbours (places) with their share of what the node sends."""

    def __init__(self, ids: np.ndarray, source: np.ndarray, to: np.ndarray, weight: np.ndarray):
        self.ids = ids
        known = np.isin(source, ids) & np.isin(to, ids) & (source != to) & (weight > 0)
        a, b, weight = np.searchsorted(ids, source[known]), np.searchsorted(ids, to[known]), weight[known]
        order = np.lexsort((b, -weight, a))
        self.to, self.weight = b[order].astype(np.int32), weight[order]
        self.first = np.searchsorted(a[order], np.arange(len(ids) + 1))
        self.share = self._shares(self.weight)

    def _shares(self, weight: np.ndarray) -> np.ndarray:
        """Weights over their node's sum, added up in the order of the neighbours."""
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        return weight / np.bincount(owner, weight, minlength=len(self.ids))[owner] if len(weight) else weight

    @classmethod
    def of(cls, nodes: DataFrame, nbrs: DataFrame, most_edges: int = MOST_EDGES) -> PackedGraph:
        """From (node) and (node, neighbour, weight), behind a check of their size."""
        table = nbrs.select("node", "neighbour", F.col("weight").cast("double")).limit(most_edges + 1).toArrow()
        known = nodes.select("node").limit(most_edges + 1).toArrow()["node"]
        if max(len(table), len(known)) > most_edges:
            raise ValueError(f"over {most_edges} neighbour entries or nodes: use dynamics.heat_auc")
        ids = np.unique(known.to_numpy())
        return cls(ids, *(table[c].to_numpy() for c in ("node", "neighbour", "weight")))

    def place(self, node: int) -> int | None:
        k = int(np.searchsorted(self.ids, node))
        return k if k < len(self.ids) and self.ids[k] == node else None

    def flat(self) -> PackedGraph:
        """All weights one."""
        out = object.__new__(PackedGraph)
        out.ids, out.to, out.first, out.weight = self.ids, self.to, self.first, np.ones(len(self.to))
        out.share = out._shares(out.weight)
        return out

    def without(self, place: int, others: np.ndarray) -> PackedGraph:
        """No links between one node and the others (a mask), either way."""
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        cut = (owner == place) & others[self.to] | (self.to == place) & others[owner]
        out = object.__new__(PackedGraph)
        out.ids, out.to, out.weight = self.ids, self.to[~cut], self.weight[~cut]
        out.first = np.searchsorted(owner[~cut], np.arange(len(self.ids) + 1))
        out.share = out._shares(out.weight)
        return out

    @cached_property
    def parts(self) -> np.ndarray:
        """The smallest place that a node is linked with, over any number of links either way: no heat goes from one part to another."""
        owner, part = np.repeat(np.arange(len(self.ids)), np.diff(self.first)), np.arange(len(self.ids))
        while True:
            low, least = np.minimum(part[owner], part[self.to]), part.copy()
            np.minimum.at(least, part[owner], low)
            np.minimum.at(least, part[self.to], low)
            while (least[least] != least).any():
                least = least[least]
            if (least == part).all():
                return part
            part = least

    def part(self, place: int) -> tuple[PackedGraph, np.ndarray, int]:
        """A node's part as a graph of its own, the places of its nodes, in order, and the node's place there. The last part is kept."""
        k = int(self.parts[place])
        if self.__dict__.get("_last", (None,))[0] != k:
            own = np.flatnonzero(self.parts == k)
            n = self.first[own + 1] - self.first[own]
            first = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(self.first[own] - first[:-1], n) + np.arange(first[-1])
            out = object.__new__(PackedGraph)
            out.ids, out.to, out.first, out.weight, out.share = self.ids[own], np.searchsorted(own, self.to[at]), first, self.weight[at], self.share[at]
            self._last = k, out, own
        _, out, own = self._last
        return out, own, int(np.searchsorted(own, place))

    def hops(self, place: int, goal: np.ndarray) -> int | None:
        """Steps from a node to the nearest of the goal (a mask) other than itself."""
        seen = np.zeros(len(self.ids), bool)
        seen[place] = True
        front, steps = np.array([place]), 0
        while len(front):
            steps += 1
            near = self.spread(front)[1]
            near = np.unique(near[~seen[near]])
            if goal[near].any():
                return steps
            seen[near] = True
            front = near
        return None

    def spread(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the nodes, neighbour, share) over all their neighbours, in order."""
        n, to, share = self.links(nodes)
        return np.repeat(np.arange(len(nodes)), n), to, share

    def links(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many, by node), and (neighbour, share) over all their neighbours, in order."""
        first = self.first[nodes]
        n = self.first[nodes + 1] - first
        ends = n.cumsum()
        at = (first - ends + n).repeat(n) + np.arange(ends[-1] if len(ends) else 0)
        return n, self.to[at].astype(np.int64, copy=False), self.share[at]


class Heat:
    """Raw heat, the tick it was last brought up to, and the queue of nodes awake, in the order they woke."""

    def __init__(self, graph: PackedGraph, config: DynamicsConfig):
        n = len(graph.ids)
        self.graph, self.config, self.tick = graph, config, 0
        self.heat, self.last, self.awake = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
        self.queue, self._at, self._fade = np.zeros(0, np.int64), np.zeros(n, np.int64), np.ones(1)

    def pulse(self, place: int, heat: float) -> None:
        self.heat[place] += heat
        self._wake(np.array([place]))

    def _wake(self, nodes: np.ndarray) -> None:
        nodes = nodes[~self.awake[nodes]]
        self.awake[nodes] = True
        self.queue = np.concatenate([self.queue, nodes])

    def effective(self, nodes: np.ndarray | slice = slice(None), ahead: int = 0) -> np.ndarray:
        """Heat as of a tick: what is raw decays by the ticks gone since it was brought up to date."""
        if self.tick + ahead >= len(self._fade):
            self._fade = 0.5 ** (np.arange(2 * (self.tick + ahead) + 128) / self.config.half_life)
        return self.heat[nodes] * self._fade[self.tick + ahead - self.last[nodes]]

    def prefix(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, its heat by then) of what the next tick will work on."""
        nodes = self.queue[: self.config.active_budget]
        heat = self.effective(nodes, 1)
        return nodes[heat > 0], heat[heat > 0]

    def advance(self) -> None:
        """One tick: the first of the queue, up to the budget, decay and send a share of their heat; what arrives is added after
        all have sent. Heat at or under the floor is zeroed where it is worked on, kept raw where it arrives."""
        self.tick += 1
        nodes, self.queue = self.queue[: self.config.active_budget], self.queue[self.config.active_budget :]
        if not len(nodes):
            return
        self.awake[nodes] = False
        heat = self.effective(nodes)
        self.last[nodes] = self.tick
        warm = heat > self.config.floor
        self.heat[nodes] = np.where(warm, heat, 0.0)
        nodes, heat = nodes[warm], heat[warm]
        if self.config.diffusion > 0:
            n, to, share = self.graph.links(nodes)
            sent = np.where(n > 0, heat * self.config.diffusion, 0.0)
            self.heat[nodes] = heat - sent
            if len(to):
                order = np.arange(len(to))
                self._at[to[::-1]] = order[::-1]  # the first place of each stays
                arrived = to[self._at[to] == order]
                self._at[arrived] = order[: len(arrived)]
                heat = self.effective(arrived) + np.bincount(self._at[to], np.repeat(sent, n) * share)
                self.heat[arrived] = heat
                self.last[arrived] = self.tick
                self._wake(arrived[heat > self.config.floor])
        self._wake(nodes[self.heat[nodes] > self.config.floor])


@dataclass(frozen=True)
class Run:
    """Heat summed over the ticks, at each horizon; the most nodes awake at once; ticks with more awake than the budget."""

    totals: dict[int, np.ndarray]
    most_awake: int
    saturated: int


def run_heat(graph: PackedGraph, place: int, heat: float, horizons: list[int], config: DynamicsConfig) -> Run:
    state = Heat(graph, config)
    state.pulse(place, heat)
    total, kept = np.zeros(len(graph.ids)), {}
    most, saturated = 1, 0
    for tick in range(1, max(horizons) + 1):
        saturated += len(state.queue) > config.active_budget
        state.advance()
        total += state.heat
        most = max(most, len(state.queue))
        if tick in horizons:
            kept[tick] = total.copy()
    return Run(kept, most, saturated)


def fraction(total: np.ndarray, classes: np.ndarray) -> tuple[float | None, list[float]]:
    """related / (related + other), None without foreign heat; and the heat of each class."""
    sums = np.bincount(classes, total, minlength=3).tolist()
    foreign = sums[RELATED] + sums[OTHER]
    return (sums[RELATED] / foreign if foreign > 0 else None), sums


def relabelled(totals: np.ndarray, classes: np.ndarray, free: np.ndarray, trials: int, seed: int, strata: np.ndarray | None = None) -> np.ndarray:
    """(target, trial): the fraction of each row of totals when, trial by trial, the free nodes (a mask) exchange their classes, within
    their stratum if there are strata. All rows share a trial's draw; NaN without foreign heat."""
    rng = np.random.default_rng(seed)
    at = np.flatnonzero(free)
    groups = [at] if strata is None else [at[strata[at] == s] for s in np.unique(strata[at])]
    fixed = [totals[:, ~free & (classes == c)].sum(1) for c in (RELATED, OTHER)]
    out = np.empty((len(totals), trials))
    step = max(1, _DRAWN // max(len(at), 1))
    for a in range(0, trials, step):
        n = min(step, trials - a)
        sums = [np.repeat(x[:, None], n, 1) for x in fixed]
        for group in groups:
            drawn = rng.permuted(np.tile(classes[group], (n, 1)), axis=1)
            for c, own in zip((RELATED, OTHER), sums, strict=True):
                own += totals[:, group] @ (drawn == c).T
        foreign = sums[0] + sums[1]
        out[:, a : a + n] = np.divide(sums[0], foreign, out=np.full_like(foreign, np.nan), where=foreign > 0)
    return out


def own_null(total: np.ndarray, classes: np.ndarray, free: np.ndarray, trials: int, seed: int, elsewhere: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """``relabelled`` for one row with draws of its own. Only nodes with heat draw a class: first whether they are foreign, then whether they are
    related, each as often in a trial as a whole exchange deals it. ``elsewhere``: free nodes by class that aren't in the row, all cold."""
    rng = np.random.default_rng(seed)
    at = np.flatnonzero(free & (total != 0))
    fixed = [float(total[~free & (classes == c)].sum()) for c in (RELATED, OTHER)]
    origin, related, other = (int((free & (classes == c)).sum()) + elsewhere[c] for c in (ORIGIN, RELATED, OTHER))
    m, out = len(at), np.empty(trials)
    heat = np.zeros(-(-m // 8) * 8)
    heat[:m] = total[at]
    table = (heat.reshape(-1, 8) @ _BITS).ravel()  # of eight nodes at a time, the heat of each set of them
    step = max(1, _DEALT // max(m, 1))
    for a in range(0, trials, step):
        n = min(step, trials - a)
        among = rng.integers(0, 1 << 64, -(-n * m // 8), dtype=np.uint64).view(np.uint8)[: n * m].reshape(n, m)
        foreign, near = (np.packbits(among < _cuts(x / max(origin + related + other, 1), n), axis=1) for x in (related + other, related))
        count = lambda bits: np.bitwise_count(bits).sum(1, dtype=np.int64)
        deal = rng.hypergeometric(related + other, origin, m, n) if m else np.zeros(n, np.int64)
        near_deal = rng.hypergeometric(related, other, deal) if related + other else np.zeros(n, np.int64)
        # numbers are dealt to trials with counts like them, so few nodes change sides; which nodes a trial has is as random as before
        trial, dealt = _alike(count(foreign), count(near)), _alike(deal, near_deal)
        whole, want = np.empty(n, np.int64), np.empty(n, np.int64)
        whole[trial], want[trial] = deal[dealt], near_deal[dealt]
        over = count(foreign) - whole
        _turn(rng, m, over, foreign, lambda t, b, bit: foreign[t, b] & bit)
        near &= foreign
        _turn(rng, m, -over, foreign, lambda t, b, bit: ~foreign[t, b] & bit)
        over = count(near) - want
        _turn(rng, m, over, near, lambda t, b, bit: near[t, b] & bit)
        _turn(rng, m, -over, near, lambda t, b, bit: foreign[t, b] & ~near[t, b] & bit)
        held = lambda bits: sum(table[k << 8 :].take(np.ascontiguousarray((x := bits[:, k : k + _BYTES]).T) + (np.arange(x.shape[1]) << 8)[:, None]).sum(0) for k in range(0, bits.shape[1], _BYTES))
        both = sum(fixed) + held(foreign)
        out[a : a + n] = np.divide(fixed[0] + held(near), both, out=np.full(n, np.nan), where=both > 0)
    return out


def _cuts(share: float, trials: int) -> np.ndarray:
    """By trial, below which byte a node is drawn: one of the two bytes at the share, in as many trials as make the share on average."""
    return np.minimum(256 * share + (np.arange(trials) + 0.5) / trials, 255).astype(np.uint8)[:, None]


def _alike(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order by the first in blocks, as many as a block has rows, and within a block by the second."""
    block = np.empty(len(first), np.int64)
    block[np.argsort(first, kind="stable")] = np.arange(len(first)) // max(math.isqrt(len(first)), 1)
    return np.lexsort((second, block))


def _turn(rng: np.random.Generator, m: int, need: np.ndarray, bits: np.ndarray, fits: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Turn over the bits (trial, byte) of as many nodes as each trial needs, drawn at random one after another among those that fit;
    a bit that is turned fits no more."""
    left, many = np.maximum(need, 0), 2
    while left.any():
        trial = np.repeat(np.arange(len(left)), left * many)
        node = rng.integers(0, m, len(trial))
        ok = fits(trial, node >> 3, (128 >> (node & 7)).astype(np.uint8)) != 0
        key, first = np.unique(trial[ok] * m + node[ok], return_index=True)
        key = key[np.argsort(first)]  # by trial, then as drawn
        trial = key // m
        key = key[np.arange(len(key)) - np.searchsorted(trial, trial) < left[trial]]
        trial, node = key // m, key % m
        np.bitwise_xor.at(bits, (trial, node >> 3), (128 >> (node & 7)).astype(np.uint8))
        left = left - np.bincount(trial, minlength=len(left))
        many = min(2 * many, max(2, _DEALT // max(int(left.sum()), 1)))


def _classes(graph: PackedGraph, classes: DataFrame) -> np.ndarray:
    """0 origin, 1 related, 2 other, by place; unknown nodes are other."""
    table = classes.where(F.col("class").isin("origin", "related")).select("node", (F.col("class") == "related").alias("related")).toArrow()
    out = np.full(len(graph.ids), OTHER, np.int8)
    at = np.searchsorted(graph.ids, table["node"].to_numpy())
    inside = at < len(graph.ids)
    inside[inside] = graph.ids[at[inside]] == table["node"].to_numpy()[inside]
    out[at[inside]] = np.where(table["related"].to_numpy(zero_copy_only=False)[inside], RELATED, ORIGIN)
    return out


def _labels(graph: PackedGraph, sources: DataFrame) -> tuple[list[str], np.ndarray]:
    """The sources' names in order, and by place the number of a node's source, -1 without one."""
    names = [r[0] for r in sources.select("source").distinct().orderBy("source").collect()]
    table = sources.where("node is not null").select("node", "source").toArrow()
    of = dict(zip(table["node"].to_pylist(), table["source"].to_pylist(), strict=True))
    index = {s: k for k, s in enumerate(names)}
    return names, np.array([index.get(of.get(int(i)), -1) for i in graph.ids], np.int32)


def _over_targets(targets: DataFrame, graph: PackedGraph, columns_of: Callable[[list[int]], Iterator[dict]], schema: str, tasks: int | None = None) -> DataFrame:
    """Rows, as columns by name, made from the targets (node) of a task at a time; targets outside the graph are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    graph.parts  # found once, here, and sent with the graph

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {t for batch in batches for t in batch.column(0).to_pylist()}
        for columns in columns_of(sorted((p for t in own if (p := graph.place(t)) is not None), key=lambda p: (graph.parts[p], p))):
            yield pa.RecordBatch.from_pydict(columns, arrow)

    # no distinct() here: its shuffle would be this one, and small partitions of it are joined to one task
    wide = targets.select("node").where("node is not null").repartition(tasks or int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    return wide.mapInArrow(run, schema)


def heat_totals(nodes: DataFrame, nbrs: DataFrame, targets: DataFrame, horizons: list[int], heat: float = 10.0, config: DynamicsConfig = DynamicsConfig()) -> DataFrame:
    """(target, horizon, node, auc): raw heat summed over the ticks of a pulse at each target, where it is not zero."""
    graph = PackedGraph.of(nodes, nbrs)

    def columns_of(places: list[int]) -> Iterator[dict]:
        for near, _, p in map(graph.part, places):
            for horizon, total in run_heat(near, p, heat, horizons, config).totals.items():
                k = np.flatnonzero(total)
                yield {"target": np.full(len(k), near.ids[p]), "horizon": np.full(len(k), horizon), "node": near.ids[k], "auc": total[k]}

    return _over_targets(targets, graph, columns_of, "target long, horizon long, node long, auc double")


def pair_battery(nodes: DataFrame, nbrs: DataFrame, classes: DataFrame, *, horizons: tuple[int, ...] = (20, 60, 120, 240), primary: int = 120, heat: float = 10.0, levels: tuple[float, ...] = (1.0, 100.0), trials: int = 5000, seed: int = 20260824, config: DynamicsConfig = DynamicsConfig()) -> DataFrame:
    """One row per origin node, the pulse's target: hops to the related class, the fraction of foreign heat that reaches it at each horizon
    and under each diagnostic (other heat levels, flat weights, the target's own related links cut, no diffusion), its own null over
    ``trials`` relabellings with the target fixed, and q_bh, p_holm over the targets that can reach the class."""
    graph, horizons = PackedGraph.of(nodes, nbrs), sorted({*horizons, primary})
    every, still = _classes(graph, classes), replace(config, diffusion=0.0)
    counts = np.bincount(every, minlength=3)

    def columns_of(places: list[int]) -> Iterator[dict]:
        last = None
        for part, own, p in map(graph.part, places):
            if part is not last:
                last, flat, kinds = part, part.flat(), every[own]
                related, elsewhere = kinds == RELATED, tuple((counts - np.bincount(kinds, minlength=3)).tolist())
            target, main = int(part.ids[p]), run_heat(part, p, heat, horizons, config)
            total = main.totals[primary]
            real, sums = fraction(total, kinds)
            one = lambda g, h=heat, c=config: run_heat(g, p, h, [primary], c).totals[primary]  # noqa: B023, E731
            near = part.spread(np.array([p]))[1]
            direct = int(related[near].sum())
            free = np.arange(len(kinds)) != p
            null = own_null(total, kinds, free, trials, stable_seed(seed, str(target)), elsewhere) if real is not None else np.zeros(0)
            null = null[~np.isnan(null)]
            others = [fraction(one(part, h), kinds)[0] for h in levels]
            row = {
                "target": target, "hops": part.hops(p, related), "direct_related": direct, "direct_other": int((kinds[near] == OTHER).sum()), "real_fraction": real, "origin_auc": sums[ORIGIN], "related_auc": sums[RELATED], "other_auc": sums[OTHER],
                "by_horizon": [fraction(main.totals[h], kinds)[0] for h in horizons], "level_deviation": max((abs(x - real) for x in others if x is not None and real is not None), default=0.0),
                "flat_fraction": fraction(one(flat), kinds)[0], "lesion_fraction": fraction(one(part.without(p, related)), kinds)[0] if direct else None, "still_foreign": sum(fraction(one(part, c=still), kinds)[1][1:]),
                "most_awake": main.most_awake, "saturated_ticks": main.saturated, "null_median": float(np.median(null)) if len(null) else None, "null_q95": float(np.quantile(null, 0.95)) if len(null) else None,
                "p_right": float((1 + (null >= real).sum()) / (1 + len(null))) if len(null) else None,
            }
            yield {name: [x] for name, x in row.items()}

    schema = "target long, hops long, direct_related long, direct_other long, real_fraction double, origin_auc double, related_auc double, other_auc double, by_horizon array<double>, level_deviation double, flat_fraction double, lesion_fraction double, still_foreign double, most_awake long, saturated_ticks long, null_median double, null_q95 double, p_right double"
    rows = _over_targets(classes.where("class = 'origin'"), graph, columns_of, schema)
    rows = rows.withColumn("p_eligible", F.when(F.col("hops").isNotNull(), F.col("p_right")))
    adjusted = holm(benjamini_hochberg(rows, "p_eligible", "target"), "p_eligible", "target").drop("p_eligible")
    return adjusted.withColumn("status", F.when(F.col("hops").isNull(), "unreachable").when(F.col("real_fraction").isNull(), "no foreign heat").otherwise("ok"))


def routes(nodes: DataFrame, nbrs: DataFrame, classes: DataFrame, sources: DataFrame, *, ticks: int = 120, heat: float = 10.0, config: DynamicsConfig = DynamicsConfig()) -> DataFrame:
    """(target, hops, real_fraction, heat) per origin node from one run each: hops and real_fraction as in ``pair_battery``; heat, by source, is
    what nodes of other sources gather, where it is not zero (a node has one source; a target without one has an empty list)."""
    graph = PackedGraph.of(nodes, nbrs)
    kinds, (names, label) = _classes(graph, classes), _labels(graph, sources)

    def columns_of(places: list[int]) -> Iterator[dict]:
        for near, own, p in map(graph.part, places):
            total, mine = run_heat(near, p, heat, [ticks], config).totals[ticks], label[own[p]]
            held = np.bincount(label[own] + 1, total, minlength=len(names) + 1)[1:]
            to = [int(k) for k in np.flatnonzero(held) if k != mine] if mine >= 0 else []
            yield {"target": [near.ids[p]], "hops": [near.hops(p, kinds[own] == RELATED)], "real_fraction": [fraction(total, kinds[own])[0]], "heat": [[{"source": names[k], "heat": held[k]} for k in to]]}

    return _over_targets(classes.where("class = 'origin'"), graph, columns_of, "target long, hops long, real_fraction double, heat array<struct<source: string, heat: double>>")


def global_nulls(nodes: DataFrame, nbrs: DataFrame, classes: DataFrame, *, horizon: int = 120, heat: float = 10.0, trials: int = 10_000, seed: int = 20260824, stream: str = "calibration", by_degree: bool = False, config: DynamicsConfig = DynamicsConfig()) -> DataFrame:
    """(target, trial, fraction): each origin node's fraction under relabellings that all targets share; origin nodes are fixed. With
    ``by_degree`` only nodes of one degree exchange labels."""
    graph = PackedGraph.of(nodes, nbrs)
    kinds = _classes(graph, classes)
    degree = np.diff(graph.first) if by_degree else None
    draws = stable_seed(seed, f"global:{'degree' if by_degree else 'plain'}:{stream}")

    def columns_of(places: list[int]) -> Iterator[dict]:
        for a in range(0, len(places), 64):
            own = places[a : a + 64]
            totals = np.stack([run_heat(graph, p, heat, [horizon], config).totals[horizon] for p in own])
            for p, null in zip(own, relabelled(totals, kinds, kinds != ORIGIN, trials, draws, degree), strict=True):
                yield {"target": np.full(trials, graph.ids[p]), "trial": np.arange(trials, dtype=np.int32), "fraction": pa.array(null, from_pandas=True)}

    return _over_targets(classes.where("class = 'origin'"), graph, columns_of, "target long, trial int, fraction double")


def source_cells(nodes: DataFrame, nbrs: DataFrame, sources: DataFrame, *, ticks: int = 120, heat: float = 10.0, trials: int = 1000, seed: int = 20260824, config: DynamicsConfig = DynamicsConfig()) -> DataFrame:
    """(origin, destination, targets, real_share, null_median, null_q95, delta, p_right, q_bh): the median over an origin's targets of each
    destination's share of all foreign heat, against relabellings of the foreign nodes that the origin's targets share. Nodes
    without a source gather heat that belongs to no destination; their median share is destination null."""
    graph = PackedGraph.of(nodes, nbrs)
    names, label = _labels(graph, sources)
    wide = len(names) + 1

    def columns_of(places: list[int]) -> Iterator[dict]:
        by_origin: dict[int, list[int]] = {}
        for p in places:
            if label[p] >= 0:
                by_origin.setdefault(int(label[p]), []).append(p)
        for origin, own in by_origin.items():
            foreign = np.flatnonzero(label != origin)
            found = []
            for near, at, p in map(graph.part, own):
                total = run_heat(near, p, heat, [ticks], config).totals[ticks]
                warm = np.flatnonzero((total != 0) & (label[at] != origin))
                if len(warm):
                    found.append((np.searchsorted(foreign, at[warm]), total[warm] / total[warm].sum()))
            if not found:
                continue
            at, share = (np.concatenate(x) for x in zip(*found, strict=True))
            row = np.repeat(np.arange(len(found)) * wide + 1, [len(x) for x, _ in found])
            rng = np.random.default_rng(stable_seed(seed, names[origin]))
            for trial in range(-1, trials):
                labels = label[foreign] if trial < 0 else rng.permutation(label[foreign])
                held = np.bincount(row + labels[at], share, minlength=len(found) * wide)
                yield {"origin": [origin], "trial": [trial], "shares": [held]}

    def middle(table: pa.Table) -> pa.Table:
        origin, trial = table["origin"][0].as_py(), table["trial"][0].as_py()
        shares = np.concatenate([x.values.to_numpy() for x in table["shares"]]).reshape(-1, wide)
        to = [d for d in range(-1, len(names)) if d != origin]
        return pa.table({"origin": [names[origin]] * len(to), "destination": pa.array([names[d] if d >= 0 else None for d in to], pa.string()), "trial": pa.array([trial] * len(to), pa.int32()), "share": np.median(shares, axis=0)[[d + 1 for d in to]], "targets": pa.array([len(shares)] * len(to), pa.int64())})

    targets = sources.select("node")
    drawn = _over_targets(targets, graph, columns_of, "origin int, trial int, shares array<double>")
    medians = drawn.groupBy("origin", "trial").applyInArrow(middle, "origin string, destination string, trial int, share double, targets long")
    real = F.max(F.when(F.col("trial") < 0, F.col("share")))
    cells = medians.groupBy("origin", "destination").agg(F.max(F.when(F.col("trial") < 0, F.col("targets"))).alias("targets"), real.alias("real_share"), F.median(F.when(F.col("trial") >= 0, F.col("share"))).alias("null_median"), F.percentile(F.when(F.col("trial") >= 0, F.col("share")), F.lit(0.95)).alias("null_q95"), F.collect_list(F.when(F.col("trial") >= 0, F.col("share"))).alias("null"))
    cells = cells.withColumn("p_right", F.when(F.col("destination").isNotNull(), (1 + F.size(F.filter("null", lambda x: x >= F.col("real_share")))) / (1 + F.size("null")))).drop("null").withColumn("delta", F.col("real_share") - F.col("null_median"))
    return benjamini_hochberg(cells.withColumn("cell", F.concat_ws("\x01", "origin", "destination")), "p_right", "cell").drop("cell")


def heat_field(nodes: DataFrame, nbrs: DataFrame, targets: DataFrame, *, ticks: int = 20, heat: float = 10.0, gain: float = 0.25, map_half_life: float = 200.0, near: bool = False, config: DynamicsConfig = DynamicsConfig()) -> DataFrame:
    """(target, node, map_value, truth): after a pulse and ``ticks`` ticks, the map folded from what each tick worked on, and the heat
    itself, which only an evaluator may see. With ``near`` only the rows of the target and its neighbours in the graph, which is what
    ``field_signal`` reads."""
    graph = PackedGraph.of(nodes, nbrs)

    def columns_of(places: list[int]) -> Iterator[dict]:
        for part, _, p in map(graph.part, places):
            state, folded = Heat(part, config), np.zeros(len(part.ids))
            state.pulse(p, heat)
            for _ in range(ticks):
                worked, value = state.prefix()
                state.advance()
                folded *= 0.5 ** (1 / map_half_life)
                folded[worked] += gain * value
            truth = state.effective()
            k = np.flatnonzero((folded > 0) | (truth > 0))
            if near and len(k):  # the target stays, so that it is known to have a field
                links = np.unique(part.spread(np.array([p]))[1])
                k = np.union1d(links[(folded[links] > 0) | (truth[links] > 0)], [p])
            yield {"target": np.full(len(k), part.ids[p]), "node": part.ids[k], "map_value": folded[k], "truth": truth[k]}

    return _over_targets(targets, graph, columns_of, "target long, node long, map_value double, truth double")


def field_signal(field: DataFrame, nbrs: DataFrame) -> DataFrame:
    """Per target: how its neighbours' map values rank against the truth, their spread, and whether that says anything. The field is read
    once and dealt by target: Spark takes it to be as small as the targets that it is made from, and would send it to the driver for a join."""
    from tessera.functions.statistics import spearman

    links = nbrs.select(F.col("node").alias("target"), F.col("neighbour").alias("node"), F.lit(None).cast("double").alias("m"), F.lit(None).cast("double").alias("t"), F.lit(True).alias("link"))
    rows = field.select("target", "node", F.col("map_value").alias("m"), F.col("truth").alias("t"), F.lit(False).alias("link")).unionByName(links)
    own, pair = Window.partitionBy("target"), Window.partitionBy("target", "node")
    known = rows.withColumn("known", F.bool_or(~F.col("link")).over(own)).where("known").drop("known")
    values = known.withColumns({c: F.coalesce(F.max(c).over(pair), F.lit(0.0)) for c in ("m", "t")}).where("link")
    values = values.withColumn("spread", F.max("m").over(own) - F.min("m").over(own))
    out = spearman(values, "m", "t", ["target", "spread"]).select("target", F.col("n").alias("neighbours"), "spread", "rho")
    return out.withColumn("informative", (F.col("neighbours") >= 2) & (F.col("spread") > 1e-12) & F.col("rho").isNotNull())


def arm_views(field: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """(target, arm, node, score): the map as it is, blind (all zero), and with its values dealt to other nodes at random."""
    from tessera.operators.permutation import draw

    pair = field.select("target").distinct().join(F.broadcast(nodes.select("node").distinct()))
    whole = pair.join(field.select("target", "node", "map_value"), ["target", "node"], "left").withColumn("map_value", F.coalesce("map_value", F.lit(0.0)))
    placed = whole.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("node")))
    dealt = whole.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy(draw(seed, F.col("target"), F.col("node"))))).select("target", "k", F.col("map_value").alias("score"))
    shuffled = placed.select("target", "node", "k").join(dealt, ["target", "k"]).select("target", F.lit("shuffled").alias("arm"), "node", "score")
    real = whole.select("target", F.lit("real").alias("arm"), "node", F.col("map_value").alias("score"))
    return real.unionByName(whole.select("target", F.lit("blind").alias("arm"), "node", F.lit(0.0).alias("score"))).unionByName(shuffled)


def path_metrics(paths: DataFrame, truth: DataFrame, classes: DataFrame) -> DataFrame:
    """Per (trial, arm) over the edges that all arms of a trial have (paths: trial, arm, step from 1, node it leads to): mean heat of the
    destinations, heat of the distinct ones per edge, and their classes. truth: (trial, node, heat)."""
    from tessera.operators.permutation import matched_prefix

    edges = matched_prefix(paths).join(truth, ["trial", "node"], "left").join(classes, "node", "left").withColumn("heat", F.coalesce("heat", F.lit(0.0))).withColumn("class", F.coalesce("class", F.lit("other")))
    again = F.row_number().over(Window.partitionBy("trial", "arm", "node").orderBy("step"))
    of = lambda c: F.sum((F.col("class") == c).cast("long"))
    out = edges.withColumn("first", again == 1).groupBy("trial", "arm").agg(F.count("*").alias("edges"), F.avg("heat").alias("mean_heat"), (F.sum(F.when(F.col("first"), F.col("heat")).otherwise(0.0)) / F.count("*")).alias("unique_heat"), of("related").alias("related_edges"), of("other").alias("other_edges"), of("origin").alias("origin_edges"))
    foreign = F.col("related_edges") + F.col("other_edges")
    return out.withColumn("related_fraction", F.when(foreign > 0, F.col("related_edges") / foreign))


def routing_summary(rows: DataFrame, top: DataFrame, classes: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of a battery's result: targets with foreign heat, median and mean fraction, hop counts, and how many targets send most of their
    foreign heat to a source with related nodes. top: (target, destination)."""
    related = sources.join(classes.where("class = 'related'").select("node"), "node", "left_semi").select(F.col("source").alias("destination")).distinct()
    known = rows.where("real_fraction is not null").join(top.join(related, "destination", "left_semi").select("target", F.lit(1).alias("hit")), "target", "left")
    hop = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return known.agg(F.count("*").alias("targets"), F.median("real_fraction").alias("median_fraction"), F.avg("real_fraction").alias("mean_fraction"), hop(F.col("hops") == 1).alias("hops_1"), hop(F.col("hops") == 2).alias("hops_2"), hop(F.col("hops") >= 3).alias("hops_3_plus"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("top_related"))


def battery_summary(rows: DataFrame, horizons: list[int], tolerance: float = 0.02) -> DataFrame:
    """One row: the median fraction at each horizon, the checks of heat scale and zero diffusion, budget use, and passes of each test."""
    ok = F.col("status") == "ok"
    counted = lambda c: F.sum((ok & c).cast("long"))
    at = [F.median(F.when(ok, F.get("by_horizon", k))).alias(f"median_{h}") for k, h in enumerate(sorted(horizons))]
    return rows.agg(F.count("*").alias("targets"), counted(F.lit(True)).alias("eligible"), *at, F.max(F.when(ok, F.col("level_deviation"))).alias("level_deviation"), (F.coalesce(F.max(F.when(ok, F.col("level_deviation"))), F.lit(0.0)) <= tolerance).alias("level_ok"), (F.max(F.abs("still_foreign")) <= 1e-12).alias("still_ok"), F.max("most_awake").alias("most_awake"), F.sum("saturated_ticks").alias("saturated_ticks"), counted(F.col("real_fraction") > F.col("null_q95")).alias("over_q95"), counted(F.coalesce("q_bh", F.lit(1.0)) <= 0.05).alias("bh_05"), counted(F.coalesce("p_holm", F.lit(1.0)) <= 0.05).alias("holm_05"), counted((F.col("direct_related") == 0) & (F.col("hops") >= 2)).alias("multihop"))
