"""Sinks, codecs, folders, status, ticks as a stream and runs of several stages."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.codec import bytes_vector, probe_dim, vector_bytes
from tessera.functions.embedding import HashEmbedder
from tessera.operators import corpus, graph
from tessera.plans.runs import run_plan
from tessera.sources import corpus_files, sinks
from tessera.streaming.ticks import one_tick, run_ticks, start_state, state_before


def test_reports_take_the_place_of_old_ones(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b,c")], "k int, v string")
    for kind in ("json", "csv", "csv.gz", "tsv", "parquet"):
        at = f"{tmp_path}/{kind}"
        sinks.write_report(df.limit(0), at, kind)
        sinks.write_report(df, at, kind, files=1)
        source, options = sinks.FORMATS[kind]
        assert sorted((int(r.k), r.v) for r in spark.read.format(source).options(**options).load(at).collect()) == [(1, "a"), (2, "b,c")]
    with pytest.raises(Exception, match="no such day"):
        sinks.write_report(df.withColumn("k", F.raise_error(F.lit("no such day")).cast("int")), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2


def test_edge_lists_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 0.75), ("c", "c", 1.0), ("b", "a", 0.25)], "source string, target string, weight double")
    sinks.save_edges(e, f"{tmp_path}/e")
    assert {tuple(r) for r in sinks.load_edges(spark, f"{tmp_path}/e").collect()} == {("a", "b", 0.75), ("b", "a", 0.25)}
    new = spark.createDataFrame([("a", x, w) for x, w in (("c", 0.9), ("d", 0.8), ("e", 0.8))], e.schema)
    assert [r.target for r in graph.room_left(new, sinks.load_edges(spark, f"{tmp_path}/e"), 3).orderBy("target").collect()] == ["c", "e"]


def test_vectors_as_bytes(spark):
    df = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>")
    back = df.select(bytes_vector(2)(vector_bytes(2)("v")).alias("v")).collect()
    assert [r.v for r in back] == [[1.0, -2.5], None]
    with pytest.raises(Exception, match="2 numbers, 3 expected"):
        df.select(vector_bytes(3)("v")).collect()
    assert probe_dim(HashEmbedder(32)) == 32


def test_folders(tmp_path):
    made = corpus_files.ensure_folder(str(tmp_path / "in/deep"))
    (tmp_path / "in/deep/b.txt").write_text("b")
    (tmp_path / "in/a.txt").write_text("a")
    (tmp_path / "out.txt").write_text("o")
    (tmp_path / "in/link.txt").symlink_to(tmp_path / "out.txt")
    assert made.endswith("in/deep") and corpus_files.folder_state(str(tmp_path / "in"))[1] == [str(tmp_path / "in/a.txt"), str(tmp_path / "in/deep/b.txt")]
    assert corpus_files.folder_state(str(tmp_path / "none")) == (False, [])
    with pytest.raises(NotADirectoryError):
        corpus_files.ensure_folder(str(tmp_path / "out.txt"))
    assert corpus_files.under(str(tmp_path), "in/a.txt") == str(tmp_path / "in/a.txt")
    with pytest.raises(ValueError, match="outside"):
        corpus_files.under(str(tmp_path / "in"), "../out.txt")


def test_modules_and_names(spark):
    wanted, there = spark.createDataFrame([("m1",), ("m2",)], "module string"), spark.createDataFrame([("m1",)], "module string")
    with pytest.raises(FileNotFoundError, match="m2"):
        corpus_files.require_modules(wanted, there)
    assert corpus_files.require_modules(there, there).count() == 1
    names = spark.createDataFrame([("a/b.html",), ("a/b.md",)], "p string").select(corpus_files.harvested_name(F.col("p")).alias("p"))
    assert [r.p for r in names.collect()] == ["a/b.html.txt", "a/b.md"]


def test_status_page(spark):
    chunks = spark.createDataFrame([(1, 0), (2, 1)], "id long, territory int")
    edges = spark.createDataFrame([(1, 2)], "source long, target long")
    state = spark.createDataFrame([(1, 0.5, 1.0, 2.0)], "id long, familiarity double, mass double, heat double")
    energy = spark.createDataFrame([(4, 1.0, True)], "tick long, energy double, settled boolean")
    stimuli = spark.createDataFrame([(1,)], "id long")
    meta = spark.createDataFrame([("daemon_state", "running"), ("embedding_dim", "64"), ("watch_folder_ok", "1")], "key string, value string")
    args = (chunks, edges, state, energy, stimuli, meta)
    r = corpus.full_status(*args, runtime={"version": 3, "tick": 9, "updated_at": 95.0, "settled": False}, snapshot={"version": 3, "tick": 8}, now=100.0).first()
    assert (r.tick, r.settled, r.status_source, r.runtime_fresh, r.snapshot_tick, r.embedding_dim, r.watch_folder_ok, r.pending_stimuli, r.connected) == (9, False, "runtime", True, 8, 64, True, 1, 2)
    r = corpus.full_status(*args, runtime={"version": 2, "tick": 9}, snapshot={"version": 3, "tick": 8}).first()
    assert (r.tick, r.settled, r.status_source, r.runtime_fresh) == (8, True, "snapshot", False)
    assert corpus.full_status(*args).first().status_source == "rebuild" and corpus.full_status(chunks.limit(0), *args[1:]).first().status_source == "empty"


def test_ticks_as_a_stream(spark, tmp_path):
    state = spark.createDataFrame([("a", 0.0, 1.0, 0.0, 0), ("b", 0.0, 1.0, 0.0, 0)], "id string, familiarity double, mass double, heat double, use_count long")
    nbrs = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "node string, neighbour string, weight double")
    table, queue = f"{tmp_path}/state", tmp_path / "q"
    start_state(state, table)
    queue.mkdir()
    stimuli = [[{"id": "a", "strength": 1.0}, {"id": "zz", "strength": 1.0}], [{"id": "b", "strength": 0.5}]]
    for k, rows in enumerate(stimuli):
        (queue / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        run_ticks(spark, str(queue), table, nbrs, f"{tmp_path}/cp", once=True).awaitTermination()
    want = state
    for rows in stimuli:
        want = one_tick(want, spark.createDataFrame([(r["id"], r["strength"]) for r in rows], "id string, strength double"), nbrs)
    columns = ["id", "familiarity", "mass", "heat", "use_count"]
    got = state_before(spark, table, 99).select(*columns).orderBy("id").collect()
    assert got == want.select(*columns).orderBy("id").collect() and got[1].heat > 0.375


def test_runs_of_stages(spark, tmp_path):
    calls = []

    def ok(spark, sf_dir):
        calls.append(sf_dir)
        return spark.range(3)

    plan = tmp_path / "plan.json"
    plan.write_text(json.dumps({"stages": [{"name": "first", "query": "ok"}, {"name": "second", "query": "ok", "format": "csv"}]}))
    for _ in range(2):
        ledger = run_plan(spark, str(plan), {"ok": ok}, "sf", f"{tmp_path}/run")
    assert [e["status"] for e in ledger] == ["done", "done"] and len(calls) == 2
    assert any(f.startswith("first/") for f in json.loads((tmp_path / "run/manifest.json").read_text()))
    plan.write_text(json.dumps({"stages": [{"name": "first", "query": "ok"}, {"name": "first", "query": "ok"}]}))
    with pytest.raises(ValueError, match="own name"):
        run_plan(spark, str(plan), {"ok": ok}, "sf", f"{tmp_path}/run")
