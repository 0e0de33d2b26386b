"""What only shows in larger tables: results that must be whole, and work that must not be done again and again."""

import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import battery, dynamics, graph, permutation
from tessera.plans import queries
from tessera.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that compare each pair of a territory once, however often they read the graph.
ONCE = [
    "similarity_edges",
    "shortest_hops",
    "graph_expansion",
    "cascade_delete_edges",
    "edge_set_jaccard",
    "edge_weight_error",
    "connected_nodes",
    "degree",
    "bridge_nodes",
    "neighbour_profile",
    "source_inventory",
    "corpus_integrity",
    "softmax_walks",
    "heat_ticks",
    "heat_auc",
    "foreign_fraction",
    "null_fractions",
    "global_nulls",
    "heat_totals",
    "heat_field_signal",
    "source_cells",
    "pair_battery",
    "pair_battery_summary",
    "routing_report",
]


def test_heat_map_has_all_nodes(spark):
    touches = spark.range(5000).selectExpr("id AS node", "id AS tick", "1.0 + id AS weight")
    assert dynamics.heat_map(touches, 5000).count() == 5000
    hottest = dynamics.heat_map(touches, 5000, keep=3).collect()
    assert [r.node for r in hottest] == [4999, 4998, 4997]


def fold(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


@pytest.mark.parametrize("block", [2048, 7])
def test_blocks_find_what_all_pairs_find(spark, monkeypatch, block):
    """Copies, zero vectors, other lengths, null elements, null vectors and territories: each weight equals the plain fold's to the bit."""
    monkeypatch.setattr(graph, "BLOCK", block)
    r = random.Random(4)
    some = [[float(r.randint(-3, 3)) for _ in range(5)] for _ in range(12)]
    rows = [(f"n{k:03}", r.choice([1, 2, None]) if k % 9 == 0 else k % 2, r.choice(some) if k % 3 else [r.random() - 0.4 for _ in range(5)]) for k in range(90)]
    rows += [("zero", 1, [0.0] * 5), ("short", 1, [1.0, 2.0]), ("brief", 1, [1.0, 2.5]), ("none", 1, None), ("hole", 1, [1.0, None, 1.0, 1.0, 1.0]), ("empty", 1, []), ("same", 0, some[0]), ("same", 0, some[1])]
    got = graph.similarity_edges(spark.createDataFrame(rows, "id string, territory int, embedding array<double>"), 0.2, 4).collect()
    usable = [(i, t, v) for i, t, v in rows if t is not None and v and None not in v]
    want = []
    for source in {i for i, _, _ in usable}:
        found = []
        for i, t, v in usable:
            for j, u, w in usable if i == source else ():
                if i != j and t == u and len(v) == len(w) and (scale := fold(v, v) * fold(w, w)) > 0 and (cosine := fold(v, w) / scale**0.5) >= 0.2:
                    found.append((cosine, j))
        want += [(source, j, cosine) for cosine, j in sorted(found, reverse=True)[:4]]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ONCE)
def test_pairs_are_compared_once(spark, monkeypatch, name):
    pairs, real = spark.sparkContext.accumulator(0), graph.most_similar

    def counted(*settings):
        compare = real(*settings)

        def run(key, left, right):
            pairs.add(len(left) * len(right))
            return compare(key, left, right)

        return run

    monkeypatch.setattr(graph, "most_similar", counted)
    QUERIES[name](spark, SF).collect()
    assert pairs.value == spark.read.parquet(f"{SF}/embeddings.parquet").groupBy("label").count().selectExpr("sum(count * count)").first()[0]


def test_targets_run_in_parallel(spark):
    nodes = spark.range(400).withColumnRenamed("id", "node").cache()
    nbrs = nodes.selectExpr("node", "(node + 1) % 400 AS neighbour", "1.0 AS weight")
    out = battery.heat_totals(nodes, nbrs, nodes.union(nodes), [3])
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    assert out.groupBy("target").count().selectExpr("min(count)", "max(count)", "count(*)").first() == (4, 4, 400)


@pytest.mark.parametrize("name", ["heat_totals", "pair_battery", "source_cells"])
def test_targets_run_on_their_part_alone(spark, monkeypatch, name):
    """Forty rings of ten: no run carries the other rings along."""
    runs, carried, real = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), battery.run_heat

    def counted(graph, *settings):
        runs.add(1)
        carried.add(len(graph.ids))
        return real(graph, *settings)

    monkeypatch.setattr(battery, "run_heat", counted)
    nodes = spark.range(400).withColumnRenamed("id", "node").cache()
    nbrs = nodes.selectExpr("node", "(node + 40) % 400 AS neighbour", "1.0 AS weight")
    classes = nodes.selectExpr("node", "CASE WHEN node % 7 = 0 THEN 'origin' WHEN node % 7 < 3 THEN 'related' ELSE 'other' END AS class")
    if name == "heat_totals":
        out = battery.heat_totals(nodes, nbrs, nodes, [3])
        assert {(r.target, r.node) for r in out.collect()} == {(t, (t + 40 * k) % 400) for t in range(400) for k in range(4)}
    elif name == "pair_battery":
        out = battery.pair_battery(nodes, nbrs, classes, horizons=(4,), primary=4, trials=10)
        assert {r.target for r in out.collect()} == set(range(0, 400, 7))
    else:
        out = battery.source_cells(nodes, nbrs, classes.withColumnRenamed("class", "source"), ticks=4, trials=5)
        assert out.count() == 9
    assert runs.value >= 58 and carried.value == 10 * runs.value


def test_routing_report_runs_each_target_once(spark, monkeypatch):
    """One run a target gives what whole totals and the battery's rows give."""
    of = lambda f: f(spark, SF)
    nodes, links, kinds, names = of(queries._nodes), of(queries.nbrs), of(queries.classes), of(queries.sources)
    targets = kinds.where("class = 'origin'")
    top = permutation.top_destination(battery.heat_totals(nodes, links, targets, [120]).drop("horizon"), names)
    rows = battery.pair_battery(nodes, links, kinds, trials=1)
    want = battery.routing_summary(rows, top, kinds, names).first()
    got = battery.routes(nodes, links, kinds, names)
    assert {(r.target, r.hops, r.real_fraction) for r in got.collect()} == {(r.target, r.hops, r.real_fraction) for r in rows.collect()}
    assert {tuple(r) for r in permutation.hottest(got.select("target", F.inline("heat"))).collect()} == {tuple(r) for r in top.collect()}
    runs, real = spark.sparkContext.accumulator(0), battery.run_heat

    def counted(*settings):
        runs.add(1)
        return real(*settings)

    monkeypatch.setattr(battery, "run_heat", counted)
    assert tuple(QUERIES["routing_report"](spark, SF).first()) == pytest.approx(tuple(want), rel=1e-12) and runs.value == targets.count()


def test_parts_are_what_is_linked():
    r = np.random.default_rng(6)
    for n, links in ((60, 30), (60, 90), (300, 280), (5, 0)):
        a, b = r.integers(0, n, (2, links))
        g = battery.PackedGraph(np.arange(n) * 2, a * 2, b * 2, r.random(links))
        near = {k: {k} for k in range(n)}
        for x, y in zip(a, b, strict=True):
            if near[x] is not near[y]:
                near[x] |= near[y]
                near |= dict.fromkeys(near[y], near[x])
        assert g.parts.tolist() == [min(near[k]) for k in range(n)]
        for k in range(0, n, 7):
            part, own, p = g.part(k)
            assert set(own) == near[k] and own[p] == k
            whole, local = (battery.run_heat(x, at, 10.0, [30], battery.DynamicsConfig(active_budget=4)).totals[30] for x, at in ((g, k), (part, p)))
            assert (whole[own] == local).all() and whole.sum() == pytest.approx(local.sum())


def test_own_nulls_deal_as_a_whole_exchange_does():
    r = np.random.default_rng(3)
    kinds, total = r.integers(0, 3, 60), np.where(r.random(60) < 0.4, r.random(60), 0.0)
    free = np.arange(60) != 5
    own, whole = (f for f in (battery.own_null(total, kinds, free, 20_000, 1), battery.relabelled(total[None], kinds, free, 20_000, 2)[0]))
    assert all(abs(np.nanquantile(own, x) - np.nanquantile(whole, x)) < 0.02 for x in (0.05, 0.25, 0.5, 0.75, 0.95))
    four = battery.own_null(np.array([5.0, 1.0, 2.0, 4.0]), np.array([0, 1, 2, 2]), np.array([False, True, True, True]), 6000, 7)
    values, counts = np.unique(np.round(four, 9), return_counts=True)
    assert np.allclose(values, [1 / 7, 2 / 7, 4 / 7]) and counts.min() > 1850
    assert np.isnan(battery.own_null(np.zeros(60), kinds, free, 10, 1)).all()


@pytest.mark.parametrize("shares", [(0.2, 0.5, 0.3), (0.02, 0.01, 0.97), (0.9, 0.0, 0.1), (0.0, 0.5, 0.5), (0.1, 0.9, 0.0)])
def test_own_nulls_count_the_cold_nodes_elsewhere(shares):
    """Mean, spread and how often two nodes are both related are those of drawing without replacement."""
    r = np.random.default_rng(8)
    kinds, total = r.choice(3, 400, p=shares), np.where(np.arange(400) < 90, r.random(400) + 0.1, 0.0)
    free = np.arange(400) != 5
    whole = battery.relabelled(total[None], kinds, free, 20_000, 2)[0]
    elsewhere = tuple(np.bincount(kinds[90:], minlength=3).tolist())
    own = battery.own_null(total[:90], kinds[:90], free[:90], 20_000, 1, elsewhere)
    assert abs(np.isnan(own).mean() - np.isnan(whole).mean()) < 0.02
    for f in (np.nanmean, np.nanstd, *(lambda x, q=q: np.nanquantile(x, q) for q in (0.05, 0.5, 0.95))):
        assert abs(f(own) - f(whole)) < 0.012


def test_own_nulls_give_each_dealing_its_share():
    """All 90 ways to deal two related, two other and two origin places to six nodes, two of them cold and not in the row."""
    heat = (1.0, 2.0, 4.0, 8.0)
    want = Counter()
    for dealt in set(itertools.permutations((0, 0, 1, 1, 2, 2))):
        related, other = (sum(x for x, c in zip(heat, dealt) if c == k) for k in (1, 2))
        want[round(related / (related + other), 9) if related + other else None] += 24_000 / 90
    got = battery.own_null(np.array(heat), np.array([0, 1, 1, 2]), np.ones(4, bool), 24_000, 3, (1, 0, 1))
    got = Counter(round(float(x), 9) if x == x else None for x in got)
    assert got.keys() == want.keys() and all(abs(got[k] - n) < 5 * n**0.5 for k, n in want.items())


def test_heat_totals_are_rounded_as_sql_rounds(spark, monkeypatch):
    """Doubles whose shortest form ends in the digit that decides: as decimals they go up, scaled by a power of ten not always."""
    heat = [2.427399735, 9.571162815, 8.285059715, 8.935002455, 0.25, 1e-10, 2400.0]
    monkeypatch.setattr(queries.battery, "heat_totals", lambda *a, **k: spark.createDataFrame([(x,) for x in heat], "auc double"))
    monkeypatch.setattr(queries, "_nodes", lambda *a: None)
    monkeypatch.setattr(queries, "nbrs", lambda *a: None)
    got = [r[0] for r in queries.heat_totals(spark, "/root/testdata/sf0.001").collect()]
    assert got == [r[0] for r in duckdb.execute(f"SELECT round(unnest({heat}::DOUBLE[]), 8)").fetchall()]


def test_own_nulls_turn_few_nodes(monkeypatch):
    """Of 4,000 warm nodes under 15 a trial change sides after the draw; as many trials as fit at a time are dealt the counts nearest to their own."""
    turned, turn = [], battery._turn
    monkeypatch.setattr(battery, "_turn", lambda rng, m, need, *rest: (turned.append(np.maximum(need, 0).sum()), turn(rng, m, need, *rest)))
    r = np.random.default_rng(5)
    kinds = r.choice(3, 4000, p=[1 / 7, 2 / 7, 4 / 7])
    battery.own_null(r.random(4000), kinds, np.ones(4000, bool), 1000, 3, (5000, 10_000, 20_000))
    assert sum(turned) < 15 * 1000


def _ranked(xs):
    return np.array([np.mean([(y < x) + (y <= x) - 1 for y in xs]) for x in xs])


def test_field_signal_reads_a_field_once_and_off_the_driver(spark, monkeypatch):
    """Each target has one run, on its part; no join sends the field to the driver; the target's and its neighbours' rows say what the whole field does."""
    runs, carried, real = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), battery.Heat

    def counted(graph, config):
        runs.add(1)
        carried.add(len(graph.ids))
        return real(graph, config)

    monkeypatch.setattr(battery, "Heat", counted)
    r = random.Random(9)
    rows = {(20 * part + a, 20 * part + b): r.choice([0.25, 0.5, 0.75]) for part in range(5) for a in range(19) for b in ((a + 1) % 19, *r.sample(range(19), 4)) if a != b}
    nodes = spark.range(100).withColumnRenamed("id", "node").cache()
    nbrs = spark.createDataFrame([(*k, w) for k, w in rows.items()], "node long, neighbour long, weight double").cache()
    targets = nodes.where("node % 20 > 12").union(spark.sql("SELECT * FROM VALUES (14L), (999L), (NULL) AS v(node)"))  # 19, 39, ... have no links
    own = [k for k in range(100) if k % 20 > 12]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for settings in ({"ticks": 7}, {"ticks": 2, "gain": 0.0, "config": battery.DynamicsConfig(floor=8.79)}, {"ticks": 0}):
        whole, near = (battery.heat_field(nodes, nbrs, targets, near=x, **settings) for x in (False, True))
        field = {(x.target, x.node): (x.map_value, x.truth) for x in whole.collect()}
        linked = {(t, n) for t, n in field if t == n or (t, n) in rows}
        got = {(x.target, x.node): (x.map_value, x.truth) for x in near.collect()}
        assert linked <= set(got) <= linked | {(t, t) for t in own} and all(got[k] == field.get(k, (0.0, 0.0)) for k in got)
        before = runs.value, carried.value
        signal = battery.field_signal(near, nbrs)
        rows_of = {x.target: x for x in signal.collect()}
        assert runs.value - before[0] == len(own) and carried.value - before[1] == 19 * 6 * 5 + 5
        assert "Broadcast" not in plan(signal)
        assert sorted(battery.field_signal(whole, nbrs).collect()) == sorted(rows_of.values()) and set(rows_of) == {t for t in own if t % 20 < 19}
        for t, x in rows_of.items():
            m, h = np.array([field.get((t, n), (0.0, 0.0)) for a, n in rows if a == t]).T
            assert x.neighbours == len(m) and x.spread == m.max() - m.min()
            a, b = _ranked(m), _ranked(h)
            rho = np.corrcoef(a, b)[0, 1] if a.std() * b.std() > 0 else None
            assert x.rho == (None if rho is None else pytest.approx(rho)) and x.informative == (len(m) > 1 and x.spread > 1e-12 and rho is not None)
