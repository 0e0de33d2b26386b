import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from tessera.llm._words import NON_LETTER_BYTES, WordHasher
from tessera.llm.toxicity import FOLDS, chain_probabilities, drop_toxic, features, fit_chain, score_toxicity, train_toxicity

SF = "/root/testdata/sf0.1"


def corpus(n):
    rng = np.random.default_rng(3)
    filler = ["tree", "river", "stone", "cloud", "field", "light", "road", "house", "water", "night"]
    texts, bad, poor = [], [], []
    for k in range(n):
        words = list(rng.choice(filler, 30)) + [f"w{k}"]
        toxic = k % 5 == 0
        if toxic:
            words += list(rng.choice(["grumble", "snarling", "snarled"], 2))
        low = k % 7 == 0
        if low:
            words += ["blah", "blah"]
        texts.append(" ".join(rng.permutation(words)))
        bad.append(toxic)
        poor.append(low)
    return texts, np.array(bad, float), np.array(poor, float)


def digest(t):
    return xxhash.xxh3_64_intdigest(t or "")


def chain_of(texts, labels):
    rows, words, count = features(WordHasher(NON_LETTER_BYTES), pa.array(texts, pa.string()))
    sets = [np.unique(words[rows == k]) for k in range(len(texts))]
    return fit_chain(sets, count, np.array([digest(t) for t in texts], np.uint64), labels)


def plain_words(text):
    """The words of a text and the marked beginnings of longer ones, in bytes, as a set of names; and how many words it has."""
    words = re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {*words, *(b"%d^" % n + w[:n] for w in words for n in (4, 5, 6) if len(w) > n)}, len(words)


def test_words_and_stems_are_those_of_a_plain_reading():
    texts = ["Snarling snarled! Ünder_the 12trees", None, "", "a b a ABCDE abcdef", "x" * 70000 + " é"]
    rows, words, count = features(WordHasher(NON_LETTER_BYTES), pa.array(texts))
    for k, t in enumerate(texts):
        names, n = plain_words(t)
        assert count[k] == n and len(set(words[rows == k].tolist())) == len(names)
    shared = set(words[rows == 0].tolist()) & set(features(WordHasher(NON_LETTER_BYTES), pa.array(["snarling snarl"]))[1].tolist())
    assert len(shared) == 4  # the word, and its beginnings of 4, 5 and 6; the word "snarl" is no beginning


def test_chain_scores_as_a_plain_sum_and_finds_held_out_toxic_texts():
    texts, bad, poor = corpus(800)
    chain = chain_of(texts[:600], {"low": poor[:600], "toxic": bad[:600]})
    assert [c.name for c in chain] == ["low", "toxic"] and len(chain[1].earlier) == 1
    hasher = WordHasher(NON_LETTER_BYTES)
    scored = chain_probabilities(chain, hasher, pa.array(texts[600:]))
    for k, (t, y) in enumerate(zip(texts[600:], bad[600:], strict=True)):
        assert (scored[-1][k] >= chain[-1].threshold) == bool(y)
        _, words, count = features(hasher, pa.array([t]))
        earlier = []
        for link in chain:
            own = dict(zip(link.words.tolist(), link.weights.tolist(), strict=True))
            score = link.bias + sum(own.get(w, 0) for w in set(words.tolist())) + link.length * math.log1p(count[0]) + sum(a * b for a, b in zip(link.earlier, earlier, strict=True))
            earlier.append(1 / (1 + math.exp(-score)))
        assert np.allclose(earlier, [p[k] for p in scored])


def test_later_links_learn_from_out_of_fold_probabilities():
    """Labels at random, one rare word per text: a model that has seen a text could name its label, out-of-fold it can't, so the
    second link, whose label is the first one's, must not lean on it."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400).astype(float)
    texts = [" ".join(rng.choice(["tree", "river", "stone"], 5)) + f" only{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in range(400)]
    chain = chain_of(texts, {"first": y, "second": y})
    assert len(chain[0].words) == 0 and abs(chain[1].earlier[0]) < 3
    assert FOLDS == 5


def test_one_class_and_no_rows_give_constant_links():
    hasher = WordHasher(NON_LETTER_BYTES)
    for chain in (chain_of([], {"toxic": np.zeros(0)}), chain_of(["a", "b"], {"toxic": np.zeros(2)})):
        assert chain_probabilities(chain, hasher, pa.array(["a", None]))[0].max() < 0.5


def test_held_out_accuracy(spark):
    """The labels themselves are off for a few documents."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = train_toxicity(docs, labels.where("doc_id % 3 <> 0"))
    judged = score_toxicity(docs, chain).join(labels.where("doc_id % 3 = 0"), "doc_id").select("p_toxic", "toxic").collect()
    called = [(r.p_toxic >= chain[-1].threshold, r.toxic == 1) for r in judged]
    assert sum(a for a, y in called if y) >= 0.85 * sum(y for _, y in called)
    assert sum(a for a, y in called if not y) <= 0.015 * sum(not y for _, y in called)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 1), (7, 0, 1), (None, 1, 1), (6, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    chain = train_toxicity(odd_docs, labels)
    again = train_toxicity(odd_docs.repartition(3), labels)
    assert [(a.bias, a.weights.tolist(), a.threshold) for a in chain] == [(a.bias, a.weights.tolist(), a.threshold) for a in again]
    scored = score_toxicity(odd_docs, chain).collect()
    assert len(scored) == 9 and all(0 <= r["p_toxic"] <= 1 for r in scored)
    assert score_toxicity(no_docs, chain).count() == 0
    none = train_toxicity(no_docs, labels.where("1 = 0"))
    kept = drop_toxic(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == 9
