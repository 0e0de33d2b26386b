import random
import re

import numpy as np
from tessera.llm.components import connected_components, contract
from tessera.llm.near_dedup import SetSketch, drop_near_duplicates, estimate, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(docs, size, percent=80):
    sets = []
    for _, t in docs:
        w = [x.lower() for x in WORD.findall(t or "")]
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    low = [d for d, _ in docs]
    group = list(range(len(docs)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                group[find(a)] = find(b)
    least = {}
    for k, d in enumerate(low):
        least[find(k)] = min((x for x in (least.get(find(k)), d) if x is not None), default=None)
    return sorted((str(d), len(sets[k]), str(least[find(k)])) for k, d in enumerate(low))


def rows(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def families(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("aeiou") + r.choice("lmnrst") + str(r.randint(0, 40))
    docs = []
    for _ in range(n):
        base = [word() for _ in range(r.choice([1, 2, 6, 40, 120]))]
        for _ in range(r.choice([1, 1, 4, 12])):
            own = [w if r.random() > r.choice([0, 0.02, 0.06]) else word() for w in base]
            docs.append(" ".join(own))
    r.shuffle(docs)
    return list(enumerate(docs))


def test_components_equal_all_pairs(spark):
    docs = families(7, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(near_duplicates(df, size=2)) == plain(docs, 2)
    kept = {r.doc_id for r in drop_near_duplicates(df, size=2).collect()}
    assert kept == {int(d) for d, _, c in plain(docs, 2) if d == c}


def test_components_of_links():
    r = random.Random(2)
    for n in (1, 5, 60, 400):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(n)]
        nodes, roots = contract(*(np.array(x, np.int64) for x in zip(*links, strict=True)))
        least = {k: k for link in links for k in link}
        for _ in range(n):
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == least


def test_many_links_are_joined_by_steps(spark):
    links = [(k, k + 1) for k in range(0, 30)] + [(100, 130), (130, 115), (7, 7), (5, 20), (5, 20)]
    e = spark.createDataFrame(links, "a long, b long")
    want = {**{k: 0 for k in range(31)}, 100: 100, 115: 100, 130: 100}
    for most in (1000, 4):
        assert {x.node: x.component for x in connected_components(e, most).collect()} == want
    assert connected_components(e.where("a > 999")).count() == 0


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(0)
    sketch = SetSketch(256)
    for share in (0.3, 0.8, 0.95):
        both, own = int(2000 * share), 2000 - int(2000 * share)
        x = rng.integers(0, 2**63, both + own).astype(np.uint64)
        a, b = x, np.concatenate([x[:both], rng.integers(0, 2**63, own).astype(np.uint64)])
        regs = [sketch.registers(np.sort(s), np.array([0])) for s in (a, b)]
        got = estimate(regs[0], regs[1], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - both / (both + 2 * own)) < 0.12


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows(near_duplicates(odd_docs)) == plain(docs, 5)
    assert near_duplicates(no_docs).count() == 0
    odd_docs = odd_docs.withColumns({"__id__": odd_docs.doc_id, "__text__": odd_docs.text})
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "None"]
