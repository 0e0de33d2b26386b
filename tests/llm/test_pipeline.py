import corpus_pipeline
from corpus_pipeline import STAGES, run
from test_near_dedup import families, plain


def test_stages_keep_clean_documents_and_act(spark, tmp_path):
    folder = str(tmp_path)
    texts = [t for _, t in families(9, 30)]
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    toxic = [f"{t} snarling grumble snarling" for t in ("mist river tree stone " * 3, "cloud lamp road dust " * 3)]
    texts += [f"before {bench} after", "write to someone@example.com about it please", *toxic]
    train = [(10_000 + k, " ".join(["stone", "river", f"v{k}"] * 4) + (" snarling grumble" if k % 2 else ""), k % 2) for k in range(200)]
    docs = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)] + [(i, t, "en", "s0", len(t)) for i, t, _ in train]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in train], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    df, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = df.columns
    for k, (name, stage) in enumerate(STAGES):
        df = stage(spark, df, folder)
        assert name == STAGES[-1][0] or df.columns == columns
        df.write.parquet(f"{folder}/{k}")
        df = spark.read.parquet(f"{folder}/{k}")
        seen[name] = {r.doc_id: r for r in df.collect()}
    n = len(texts)
    assert set(seen["toxicity"]) == {i for i, t, *_ in docs if "snarling" not in t}
    left = sorted((i, r.text) for i, r in seen["toxicity"].items())
    assert set(seen["near_duplicates"]) == {int(d) for d, _, c in plain(left, 5) if d == c}
    assert set(seen["decontamination"]) == set(seen["near_duplicates"]) - {n - 4}
    assert set(seen["personal_data"]) == set(seen["decontamination"]) == set(seen["mixing"])
    assert seen["personal_data"][n - 3].text == "write to [EMAIL] about it please"
    assert {(r.doc_id, r.taken) for r in run(spark, folder).collect()} == {(i, r.taken) for i, r in seen["mixing"].items()}
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, odd_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = odd_docs
    for _, stage in STAGES:
        df = stage(spark, df, str(tmp_path))
    assert df.count() == 7
