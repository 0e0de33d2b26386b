"""Toxicity by a classifier chain.

Categories are predicted one after another; each link is a linear model of the document's words and stems and of the probabilities of
the categories before it. For training those come from models that haven't seen the document (out-of-fold predictions, copies of
a text always in one fold), so a link learns from what it will get, and they set the threshold of each category.

Words and stems are 64-bit hashes. The chain is fitted by one executor task, from the hash sets of at most ``most_rows`` labelled
documents per value of the last category (the smallest by a hash of their id), none longer than ``most_chars``: documented bounds
of what that task holds. Only the links' weights reach the driver. Scoring covers every document, with whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import annotate, field, give_back, select_rows
from tessera.llm._words import NON_LETTER_BYTES, WordHasher, mix64

FOLDS = 5
#: Text read into features at a time; they take about thirty times that.
_PIECE = 1 << 21
STEMS = (4, 5, 6)


@dataclass
class Link:
    """Probability of one category: logistic in the presence of words (``words`` are their sorted hashes), their number and the
    earlier probabilities."""

    name: str
    bias: float
    words: np.ndarray
    weights: np.ndarray
    earlier: list[float]
    length: float
    threshold: float = 0.5

    def probabilities(self, rows: np.ndarray, words: np.ndarray, count: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
        """Of each row, given (row, hash) of its words and stems, repeats included, and how many words it has."""
        score = self.bias + self.length * np.log1p(count)
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            known = self.words[at] == words
            present = np.unique(rows[known] * len(self.words) + at[known])
            score = score + np.bincount(present // len(self.words), self.weights[present % len(self.words)], minlength=len(count))
        for weight, p in zip(self.earlier, earlier, strict=True):
            score = score + weight * p
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def features(hasher: WordHasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the words of each text and, of longer words, of the beginnings they share with inflected forms, repeats
    included; and the number of words of each text. Words are runs of letters and non-ASCII characters, A-Z as a-z."""
    rows, words = hasher.words(texts)
    stem_rows, stems = hasher.beginnings(texts, STEMS)
    return np.concatenate([rows, stem_rows]), np.concatenate([words, stems]), np.bincount(rows, minlength=len(texts)).astype(np.float64)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression (first column is the bias), classes weighed equally, by Newton steps."""
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        w += np.clip(np.linalg.solve(curve, x.T @ (weight * (y - p)) - penalty * w), -2, 2)
    return w


def fit_chain(sets: list[np.ndarray], counts: np.ndarray, digests: np.ndarray, labels: dict[str, np.ndarray], *, least_z: float = 6.0, most_words: int = 512, ridge: float = 0.2, folds: int = FOLDS) -> list[Link]:
    """The chain over ``labels`` in order, from each document's distinct word and stem hashes, its number of words and the digest
    of its text; of equal texts the first counts. A word is used if the shares of documents with it in the two classes differ by
    ``least_z`` standard errors, at most the ``most_words`` of largest difference. A category with one value only gets a constant
    link."""
    _, first = np.unique(digests, return_index=True)
    sets, counts, digests = [sets[k] for k in first], np.asarray(counts, float)[first], digests[first]
    labels = {c: np.asarray(y, float)[first] for c, y in labels.items()}
    n = len(sets)
    fold = (mix64(digests) % np.uint64(folds)).astype(np.int64)
    logs = np.log1p(counts)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    names, cols = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    cols = cols.astype(np.int32)
    earlier = np.zeros((n, 0))
    chain = []
    for name, y in labels.items():
        ones = y.sum()
        if ones in (0, n):
            chain.append(Link(name, 4.0 if n and ones else -4.0, names[:0], np.zeros(0), [0.0] * earlier.shape[1], 0.0))
            earlier = np.column_stack([earlier, np.full(n, float(bool(n and ones)))])
            continue

        def model(own: np.ndarray, y: np.ndarray = y, earlier: np.ndarray = earlier) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Fit on the rows of a mask: (chosen words, the matrix of all rows, weights)."""
            inside = own[rows]
            with_y = np.bincount(cols[inside], y[rows[inside]], minlength=len(names))
            of = np.bincount(cols[inside], minlength=len(names))
            a, b = max((y * own).sum(), 1), max(((1 - y) * own).sum(), 1)
            mean = (of + 1) / (a + b + 2)
            z = np.abs(with_y / a - (of - with_y) / b) / np.sqrt(mean * (1 - np.minimum(mean, 0.999)) * (1 / a + 1 / b))
            usable = np.flatnonzero(z >= least_z)
            chosen = np.sort(usable[np.argsort(-z[usable], kind="stable")[:most_words]])
            place = np.full(len(names) + 1, -1)
            place[chosen] = np.arange(len(chosen))
            x = np.zeros((n, 2 + len(chosen) + earlier.shape[1]))
            x[:, 0], x[:, 1], x[:, 2 + len(chosen) :] = 1, logs, earlier
            used = place[cols] >= 0
            x[rows[used], 2 + place[cols[used]]] = 1
            return chosen, x, _fit(x[own], y[own], ridge)

        out_of_fold = np.zeros(n)
        for k in range(folds):
            held = fold == k
            if not held.any() or len(set(y[~held])) < 2:
                out_of_fold[held] = y.mean()
                continue
            _, x, w = model(~held)
            out_of_fold[held] = 1 / (1 + np.exp(-np.clip(x[held] @ w, -40, 40)))
        chosen, _, w = model(np.ones(n, bool))
        at = 2 + len(chosen)
        chain.append(Link(name, float(w[0]), names[chosen], w[2:at], w[at:].tolist(), float(w[1]), cut(out_of_fold, y)))
        earlier = np.column_stack([earlier, out_of_fold])
    return chain


def cut(p: np.ndarray, y: np.ndarray, false_cost: float = 3.0) -> float:
    """The probability that parts the classes best (the true positive rate less ``false_cost`` times the false one, as clean documents
    are to stay); amid the widest gap, in log odds, of equal ones."""
    order = np.argsort(p, kind="stable")
    odds = np.log(np.clip(p[order], 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(p[order], 1e-9, 1 - 1e-9))
    gain = np.cumsum(np.where(y[order] > 0, -1 / max(y.sum(), 1), false_cost / max((1 - y).sum(), 1)))[:-1]
    gap = np.diff(odds)
    gain = np.where(gap > 0, gain, -2)
    best = np.flatnonzero(gain >= gain.max() - 1e-12) if len(gain) else []
    if not len(best):
        return 0.5
    k = best[np.argmax(gap[best])]
    return float(1 / (1 + np.exp(-(odds[k] + odds[k + 1]) / 2)))


#: The chain of the query, (category, its condition on the labels), in order.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def _featurizer() -> Callable[[pa.Array], list]:
    import xxhash

    hasher = WordHasher(NON_LETTER_BYTES)

    def run(texts: pa.Array) -> list:
        rows, words, count = features(hasher, texts)
        order = np.lexsort((words, rows))
        rows, words = rows[order], words[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (words[1:] != words[:-1])
        rows, words = rows[new], words[new]
        edges = np.searchsorted(rows, np.arange(len(texts) + 1))
        digests = np.array([xxhash.xxh3_64_intdigest(t or "") for t in texts.to_pylist()], np.uint64)
        return [[words[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], count, pa.array(digests.view(np.int64))]

    return run


_LINKS = "place int, name string, bias double, words binary, weights binary, earlier array<double>, length double, threshold double"


def train_toxicity(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", categories: tuple[tuple[str, str], ...] = CATEGORIES, most_rows: int = 1500, most_chars: int = 1 << 17) -> list[Link]:
    """The chain from a bounded sample of labelled documents: ``most_rows`` in and out of the last category, texts of up to
    ``most_chars``. Labels with a null aren't used; of repeated labels of an id a category's 1 wins, of repeated documents of an id
    the text of the least digest. Without such documents the chain is constant."""
    names = [c for c, _ in categories]
    known = labels.select(F.col(f"`{id}`").alias("__id__"), *[F.expr(e).alias(c) for c, e in categories]).dropna()
    known = known.groupBy("__id__").agg(*[F.max(c).alias(c) for c in names])
    order = F.xxhash64(F.col("__id__").cast("string"), F.lit(17))
    part = lambda toxic: known.where(toxic).orderBy(order, "__id__").limit(most_rows)
    sample = part(F.col(names[-1])).unionByName(part(~F.col(names[-1])))
    source = docs.select(F.col(f"`{id}`").alias("__id__"), F.col(f"`{text}`").cast("string").alias("__text__")).where(F.coalesce(F.length("__text__"), F.lit(0)) <= most_chars)
    # at most 2 * most_rows labelled ids
    found = annotate(source.join(F.broadcast(sample.select("__id__")), "__id__", "left_semi"), "__text__", _featurizer, [field("words", "binary"), field("n", "double"), field("digest", "long")], ["__id__"], _PIECE)
    one = found.groupBy("__id__").agg(F.min_by(F.struct("words", "n", "digest"), "digest").alias("x")).select("__id__", "x.*")
    rows = one.join(F.broadcast(sample), "__id__").select("words", "n", "digest", *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(names)])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        column = lambda c: np.concatenate([np.zeros(0), *(b.column(c).to_numpy(zero_copy_only=False) for b in table)])
        sets = [np.frombuffer(x, np.uint64) for b in table for x in b.column("words").to_pylist()]
        digests = np.concatenate([np.zeros(0, np.int64), *(b.column("digest").to_numpy() for b in table)]).view(np.uint64)
        chain = fit_chain(sets, column("n"), digests, {c: column(f"y{k}") for k, c in enumerate(names)})
        table = sets = None
        give_back()
        yield pa.RecordBatch.from_pylist([{"place": k, "name": c.name, "bias": c.bias, "words": c.words.tobytes(), "weights": c.weights.tobytes(), "earlier": c.earlier, "length": c.length, "threshold": c.threshold} for k, c in enumerate(chain)], _LINK_TYPES)

    links = sorted(rows.repartition(1).mapInArrow(fit, _LINKS).collect(), key=lambda r: r["place"])
    if not links:
        return fit_chain([], np.zeros(0), np.zeros(0, np.uint64), {c: np.zeros(0) for c in names})
    return [Link(r["name"], r["bias"], np.frombuffer(bytes(r["words"]), np.uint64), np.frombuffer(bytes(r["weights"])), list(r["earlier"]), r["length"], r["threshold"]) for r in links]


_LINK_TYPES = pa.schema([("place", pa.int32()), ("name", pa.string()), ("bias", pa.float64()), ("words", pa.binary()), ("weights", pa.binary()), ("earlier", pa.list_(pa.float64())), ("length", pa.float64()), ("threshold", pa.float64())])


def chain_probabilities(chain: list[Link], hasher: WordHasher, texts: pa.Array) -> list[np.ndarray]:
    rows, words, count = features(hasher, texts)
    out: list[np.ndarray] = []
    for link in chain:
        out.append(link.probabilities(rows, words, count, out[:]))
    return out


def _scorer(chain: list[Link]) -> Callable[[], Callable[[pa.Array], list]]:
    def make():
        hasher = WordHasher(NON_LETTER_BYTES)
        return lambda texts: [pa.array(p) for p in chain_probabilities(chain, hasher, texts)]

    return make


def score_toxicity(docs: DataFrame, chain: list[Link], *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and one probability column ``p_<category>`` per link.

    Null and empty texts are scored as documents without words. Repeated rows are each scored. Without labelled rows, or with
    one class only, the chain is constant and nothing is called toxic unless every label was.
    """
    return annotate(docs, text, _scorer(chain), [field(f"p_{c.name}", "double") for c in chain], keep, _PIECE)


def drop_toxic(docs: DataFrame, chain: list[Link], *, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose probability of the chain's last category reaches its threshold.

    Null and empty texts are judged as documents without words, repeated rows each, and alike; an empty table stays empty and
    columns stay as they are.
    """

    def make():
        hasher = WordHasher(NON_LETTER_BYTES)
        return lambda texts: chain_probabilities(chain, hasher, texts)[-1] < chain[-1].threshold

    return select_rows(docs, text, make, _PIECE)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chain = train_toxicity(docs, labels)
    return score_toxicity(docs, chain).select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= chain[-1].threshold).alias("toxic"))
