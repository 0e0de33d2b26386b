import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from tessera.llm import ngram
from tessera.llm._words import SPACE_BYTES, WordHasher, mix64
from tessera.llm.ngram import discounts, score_texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def expected(docs, of=discounts):
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
    docs = [(i, [*(w.lower() for w in WORD.findall(t or "")), None]) for i, t in docs]
    pairs, words = Counter(), Counter()
    for i, t in docs:
        if not held(i):
            words.update(t)
            pairs.update(zip([0, *t], t))
    n, v = sum(words.values()), len(words)
    left, cont = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (u, w), c in pairs.items():
        left[u][0] += c
        left[u][min(c, 3)] += 1
        cont[w] += 1
    d, e = (of(*[sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (pairs, cont))
    total = sum(cont.values())
    spare = sum(e[min(c, 3)] for c in cont.values()) / total if total else 1.0
    low = lambda w: max(cont[w] - e[min(cont[w], 3)], 0) / max(total, 1) + spare / (v + 1)

    def p(u, w):
        x = left.get(u)
        return low(w) if not x else max(pairs[u, w] - d[min(pairs[u, w], 3)], 0) / x[0] + (d[1] * x[1] + d[2] * x[2] + d[3] * x[3]) / x[0] * low(w)

    if words:
        u = next(iter(left))
        assert abs(sum(p(u, w) for w in words) + p(u, "never seen") - 1) < 1e-9
    return sorted((str(i), held(i), len(t), sum(words[w] > 0 for w in t), n, round(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t), 2), round(sum(math.log10(p(a, b)) for a, b in zip([0, *t], t)), 2)) for i, t in docs)


def scored(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 2), round(r.score, 2)) for r in df.collect())


def test_scores_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(ngram, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(ngram, "RANGE_TOKENS", 500)
    vocabulary = "the of and river stone cloud field light road house".split()
    rows = [(k, " ".join(vocabulary[(k * j + j * j + k // 3) % 10] for j in range(1 + k % 40)) + f" w{k % 9}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert scored(score_texts(docs)) == expected(rows)


def test_words_that_share_32_bits_share_nothing(spark):
    names = [f"w{k}" for k in range(300_000)]
    _, hashes = WordHasher(SPACE_BYTES).words(pa.array(names))
    for cut in (lambda h: h >> np.uint64(32), lambda h: mix64(h) >> np.uint64(32)):
        order = np.argsort(cut(hashes), kind="stable")
        k = np.flatnonzero(np.diff(cut(hashes)[order]) == 0)[0]
        a, b = names[order[k]], names[order[k + 1]]
        rows = [(i, f"{a} one {a} two {b} three" if i % 3 else f"{b} one {b} four") for i in range(60)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert scored(score_texts(docs)) == expected(rows)


def test_ranges_follow_the_tokens_and_change_nothing(spark, monkeypatch):
    rows = [(k, " ".join(f"w{(k * j) % 37}" for j in range(30)) + " the" * (k % 9)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram, "RANGE_TOKENS", 150)
    assert ngram._heavy_words(docs.selectExpr("text as __text__"))[1] == -(-sum(len(WORD.findall(t)) + 1 for _, t in rows) // 150)
    assert scored(score_texts(docs)) == expected(rows)


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert scored(score_texts(odd_docs)) == expected(rows)
    assert score_texts(no_docs).count() == 0
