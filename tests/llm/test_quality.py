import random
import re
from collections import Counter

from tessera.llm.quality import WORD_SHARES, measure_quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_counts_equal_plain_ones(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "bb", " ", "\n", " ", "\t", "é", "#", "|", "\x0b", "\x1f", "a b c "]) for _ in range(r.randint(0, 400))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in measure_quality(docs).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == plain(texts[x.doc_id]), texts[x.doc_id]


PROSE = {
    "en": "It was late in the evening when the train came to the small town on the river, and the few people on the platform were tired of the rain that had not stopped for days. The old man with the lamp went from one end to the other, as he did every night, and looked for a letter that was to come from the city. Nobody spoke to him and he did not mind, for he had the habit of waiting.",
    "de": "Es war spät am Abend, als der Zug in der kleinen Stadt am Fluss ankam, und die wenigen Leute auf dem Bahnsteig waren müde von dem Regen, der seit Tagen nicht aufgehört hatte. Der alte Mann mit der Lampe ging von einem Ende zum anderen, wie er es jede Nacht tat, und suchte nach einem Brief, der aus der Stadt kommen sollte. Niemand sprach mit ihm und das störte ihn nicht.",
}


SECOND = {
    "en": "In the morning the rain was over and the river had gone down. The first train of the day was full, and a boy in a grey coat gave the old man what he had waited for, with a stamp that nobody in the town had seen before.",
    "de": "Am Morgen war der Regen vorbei und das Wasser in dem Fluss war gefallen. Der erste Zug des Tages war voll, und ein Junge mit einem grauen Mantel gab dem alten Mann den Brief, auf den er in all den Nächten gewartet hatte, und ging dann zu den anderen Leuten.",
}


def test_prose_stays_and_junk_goes(spark):
    junk = " ".join(w + "***%%%$$$" for w in PROSE["en"].split())
    docs = spark.createDataFrame([(0, PROSE["en"]), (1, PROSE["de"]), (2, junk), (3, PROSE["en"].upper())], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in measure_quality(docs).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}


def test_long_text_without_common_words_goes(spark):
    r = random.Random(8)
    words = ["".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(2, 9))) for _ in range(400)]
    gibberish = " ".join(w for w in words if w not in {x for ref in WORD_SHARES.values() for x in ref})
    docs = spark.createDataFrame([(0, gibberish), (1, PROSE["en"] + " " + SECOND["en"]), (2, PROSE["de"] + " " + SECOND["de"])], "doc_id long, text string")
    got = {x.doc_id: x for x in measure_quality(docs).collect()}
    assert {k: x.kept for k, x in got.items()} == {0: False, 1: True, 2: True}
    assert not any(x.base_failed or x.class_distance > 0.3 for x in got.values()) and all(x.word_distance is not None for x in got.values())


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    got = measure_quality(odd_docs, keep=tuple(odd_docs.columns)).collect()
    assert len(got) == 9 and not any(r.kept for r in got if r.doc_id in (1, 2, 3))
    assert measure_quality(no_docs).count() == 0
