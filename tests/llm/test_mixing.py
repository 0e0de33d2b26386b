from collections import defaultdict

from tessera.llm.mixing import mix_sources


def targets(sizes, most=3.0):
    """By repeated resharing: sources by code point, null last, weights 1, 2, 3 repeating."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full = {}
    while True:
        left = sum(sizes.values()) - sum(full.values())
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s: most * sizes[s] for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return full | share
        full |= over


def test_targets_and_takes(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7 % 90)), [None, "a", "b", "b", "b", "c", "c", "D", "é", "hot", "hot", "hot", "hot"][k % 13]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mix_sources(docs.repartition(7)).collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == 1 + r.doc_id * 7 % 90 and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = targets(sizes)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(5, 0.01 * want[s]), (s, taken[s], want[s])


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    got = mix_sources(odd_docs).collect()
    assert len(got) == 9 and all(r.taken <= 3 * r["size"] for r in got)
    assert {r["size"] for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mix_sources(no_docs).count() == 0
