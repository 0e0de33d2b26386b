import random
import re

from tessera.llm import decontaminate
from tessera.llm.decontaminate import drop_contaminated, find_contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((str(d), len(w), len(hit), ",".join(sorted(map(str, found)))))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in df.collect())


def make(spark):
    r = random.Random(2)
    say = lambda n: " ".join(r.choice(["the", "of", "Tree", "Fluß", "7", "sky"]) for _ in range(n))
    items = [(k, say(r.choice([0, 1, 3, 9, 10, 11, 30]))) for k in range(30)] + [(None, say(12)), (5, say(10)), (40, None)]
    docs = [(k, say(r.randint(0, 60)) + (" " + items[r.randrange(30)][1] + ", " + say(3) if k % 4 == 0 else "")) for k in range(150)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_hits_equal_plain_search_and_blocks_change_nothing(spark, monkeypatch):
    docs, items, d, b = make(spark)
    assert rows(find_contamination(d, b)) == plain(docs, items)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", 40)
    assert rows(find_contamination(d, b, filter_blocks=1)) == plain(docs, items)
    clean = {k for k, _, n, _ in plain(docs, items) if n == 0}
    assert {str(r.doc_id) for r in drop_contaminated(d, b).collect()} == clean


def test_proximity(spark):
    item = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    docs = [(1, "alpha beta gamma delta x epsilon zeta eta theta iota kappa"), (2, "alpha beta nothing of this kind"), (3, item[0][1])]
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string")).collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (1, 1)}


def near_plain(docs, items, slack=2, misses=2):
    windows = {(i, tuple(w[k : k + 10])) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - 9))}
    out = {}
    for d, t in docs:
        at = {}
        for p, x in enumerate(words(t)):
            at.setdefault(x, []).append(p)
        out[d] = len({i for i, w in windows if len(w) > 2 * misses and any(sum(any(abs(p - s - o) <= slack for p in at.get(x, [])) for o, x in enumerate(w)) >= len(w) - misses for s in range(-9, len(words(t)) + 9))})
    return out


def test_proximity_equals_plain_search_with_many_documents(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.sample(vocabulary, 9) + [f"rare{k}"])) for k in range(12)]
    docs = []
    for k in range(120):
        w = items[k % 12][1].split()
        for at in r.sample(range(10), r.randint(0, 3)):
            w[at] = "changed"
        if k % 3 == 0:
            w[-1] = "changed"
        for _ in range(r.randint(0, 5)):
            w.insert(r.randint(1, 9), "more")
        docs.append((k, " ".join(r.choices(vocabulary, k=5) + w + [f"rare{r.randrange(12)}"])))
    want = near_plain(docs, items)
    exact = {k for k, t in docs if any(i in t for _, i in items)}
    assert sum(n > 0 for k, n in want.items() if k not in exact) > 20
    d, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    assert {x.doc_id: x.n_near_items for x in find_contamination(d, b).collect()} == want


def test_rows_of_one_item_are_one_item_and_extra_columns_clash_with_nothing(spark):
    b = spark.createDataFrame([("a", "one two three"), ("a", "one two three"), ("a", "three four"), ("b", "one two three")], "item_id string, text string")
    d = spark.createDataFrame([(1, "say one two three four", 7, "x", 9, "y"), (2, "two", 8, "z", 9, "y")], "doc_id long, text string, n_hit long, block string, row long, items string")
    found = find_contamination(d, b, keep=("doc_id", "text", "n_hit", "block", "row", "items"))
    assert found.columns == ["doc_id", "text", "block", "row", "n_words", "n_hit", "n_items", "items", "n_near_items"]
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == [(1, "say one two three four", "x", 9, 5, 4, 2, ["a", "b"], 2), (2, "two", "z", 9, 1, 0, 0, [], 0)]
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "one and the same"), (2, None)], "item_id long, text string")
    assert rows(find_contamination(odd_docs, b)) == plain([(r.doc_id, r.text) for r in odd_docs.collect()], [(1, "one and the same")])
    assert find_contamination(no_docs, b).count() == 0
    assert drop_contaminated(odd_docs, b.where("1 = 0")).count() == 9
