import pytest
from pyspark.sql import functions as F

from tessera.functions.embedding import HashEmbedder, InputTooLong, complete_sources, embed_all, embed_chunks
from tessera.operators import corpus, walks


def test_split_retry_keeps_all_text():
    model = HashEmbedder(8, 300)
    prose = " ".join(f"Sentence number {k} is here." for k in range(40))
    parts = embed_all(model, prose)
    assert all(len(t) <= 300 for t, _ in parts) and " ".join(t for t, _ in parts) == prose
    run = "x" * 5000
    assert "".join(t for t, _ in embed_all(model, run)) == run
    with pytest.raises(InputTooLong):
        embed_all(HashEmbedder(8, 10), prose)


def test_a_source_is_replaced_whole_or_not_at_all(spark):
    cut = spark.createDataFrame([("a", 0, "short"), ("a", 1, "y" * 200), ("b", 0, "fine")], "source string, index long, text string")
    out = embed_chunks(cut, lambda: HashEmbedder(8, 40))
    assert {r.status for r in out.where("source = 'a'").collect()} == {"ok", "too_long"}
    assert {r.source for r in complete_sources(out).collect()} == {"b"}


def frozen(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0], 1.0), ("b", [0.0, 1.0], 2.0)], "id string, embedding array<float>, created_at double")
    provenance = spark.createDataFrame([("a", "x/one.txt"), ("b", "y/one.txt"), ("b", "z/two.txt")], "chunk_id string, source string")
    edges = spark.createDataFrame([("a", "b", 0.5)], "source string, target string, weight double")
    return corpus.FrozenCorpus(chunks, provenance, edges)


def test_frozen_corpus_is_checked(spark, tmp_path):
    good = frozen(spark)
    assert corpus.freeze(good, f"{tmp_path}/good")["dangling_edges"] == 0
    assert corpus.load_frozen(spark, f"{tmp_path}/good").chunks.count() == 2
    corpus.freeze(corpus.FrozenCorpus(good.chunks.where("id = 'a'"), good.provenance, good.edges), f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="dangling_edges: 1"):
        corpus.load_frozen(spark, f"{tmp_path}/bad")


def test_sources_resolve_by_path_or_unique_name(spark):
    p = frozen(spark).provenance
    assert corpus.resolve_source(p, "x/one.txt") == "x/one.txt" and corpus.resolve_source(p, "two.txt") == "z/two.txt"
    for wanted in ("one.txt", "none.txt"):
        with pytest.raises(ValueError):
            corpus.resolve_source(p, wanted)


def test_snapshots(spark, tmp_path):
    state = spark.createDataFrame([("a", 1.0)], "node string, heat double")
    assert corpus.load_snapshot(spark, f"{tmp_path}/none") is None
    corpus.save_snapshot(state, state, {"half_life": 120}, -3, f"{tmp_path}/s")
    got, _, about = corpus.load_snapshot(spark, f"{tmp_path}/s")
    assert got.count() == 1 and about == {"version": 3, "tick": 0, "config": {"half_life": 120}}


def test_walks_stay_on_the_graph_and_follow_scores(spark):
    n = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("b", "a", 1.0), ("c", "a", 1.0)], "node string, neighbour string, weight double")
    scores = spark.createDataFrame([("b", 2.0)], "node string, score double")
    starts = spark.range(2000).select(F.col("id").alias("walk"), F.lit("a").alias("node"))
    first = walks.softmax_walks(n, scores, starts, 1, 5).where("step = 1").groupBy("node").count()
    share = {r.node: r["count"] / 2000 for r in first.collect()}
    assert abs(share["b"] - 0.8808) < 0.03 and sum(share.values()) == 1
