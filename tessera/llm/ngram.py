"""Interpolated modified Kneser-Ney bigram scores of every text, from counts over the whole corpus.

Words and contexts are 64-bit hashes. The model is stored as sorted hash arrays, one row per range of words: the words with their
counts and continuation counts, and the contexts that occur in the range with their totals and back-off weights. A worker that
scores a range maps the arrays of that range from a scratch file, written one after another, so its memory follows the range and
not the model. How many ranges there are follows the number of tokens.

Three readings of the corpus: heavy words (their pairs are spread over all ranges, so no range holds a hot word), pair counts,
and scoring. What is shuffled is aggregated before: distinct pairs with the documents they are in, never single tokens.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._arrow import pieces
from tessera.llm._storage import materialize, release
from tessera.llm._words import SPACE_BYTES, WordHasher, mix64

END, BEGIN = mix64(np.array([0xE0D, 0xB0B], np.uint64))
#: Tokens whose pairs are aggregated before the shuffle; a worker holds about 150 bytes for each.
CHUNK_TOKENS = 1_000_000
#: Tokens to a range of words, on average, and the most ranges.
RANGE_TOKENS = 3_000_000
MOST_RANGES = 1 << 14


def tokens(hasher: WordHasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, context hash): the words of each row and one end; the context is the token before, or the beginning."""
    n = len(texts)
    rows, words = hasher.words(texts)
    count = np.bincount(rows, minlength=n)
    ends = np.cumsum(count + 1) - 1
    out = np.empty(len(words) + n, np.uint64)
    out[np.arange(len(words)) + rows] = words
    out[ends] = END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[ends - count] = BEGIN
    return np.repeat(np.arange(n), count + 1), out, mix64(before)


def _range_of(words: np.ndarray, contexts: np.ndarray, heavy: np.ndarray, ranges: int) -> np.ndarray:
    """A range of words, but by word and context for heavy words."""
    spread = np.where(np.isin(words, heavy), mix64(words ^ (contexts * np.uint64(0x9E3779B97F4A7C15))), words) if len(heavy) else words
    return (((spread >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, 255 and more in a second array."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype(np.uint32).tobytes()


def _large(small: bytes, big: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(big, np.uint32)
    return out


class _Pairs:
    """The distinct (word, context) pairs of a chunk in order of range, word and context, and where each token lies among them."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, heavy: np.ndarray, ranges: int):
        order = np.lexsort((contexts, words))
        at = _starts(words[order], contexts[order])
        size = np.diff(np.append(at, len(order)))
        w, u = words[order[at]], contexts[order[at]]
        r = _range_of(w, u, heavy, ranges)
        by_range = np.argsort(r.astype(np.uint16) if ranges <= 1 << 16 else r, kind="stable")
        self.words, self.contexts, self.ranges, self.sizes = w[by_range], u[by_range], r[by_range], size[by_range]
        begin = np.repeat(at[by_range] - (np.cumsum(self.sizes) - self.sizes), self.sizes)
        self.order = order[begin + np.arange(len(order))]

    def slices(self) -> Iterator[tuple[int, int, int]]:
        first = _starts(self.ranges)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(self.ranges)], strict=True):
            yield int(self.ranges[a]), a, b

    def packed(self, a: int, b: int) -> dict[str, bytes]:
        first = _starts(self.words[a:b])
        return {"w": self.words[a:b][first].tobytes(), "k": np.diff(np.append(first, b - a)).astype(np.uint32).tobytes(), "u": self.contexts[a:b].tobytes()}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, held-out flags, document of each token, token, context) of about CHUNK_TOKENS tokens; documents stay whole."""
    hasher = WordHasher(SPACE_BYTES)
    ids, held, parts, size = [], [], [], 0

    def joined() -> list[np.ndarray]:
        out = [np.concatenate(x) for x in zip(*parts, strict=True)]
        parts.clear()
        return out

    for batch in batches:
        for piece in pieces(batch, "__text__"):
            rows, w, u = tokens(hasher, piece.column("__text__"))
            parts.append(((rows + len(ids)).astype(np.int32), w, u))
            ids += piece.column("__id__").to_pylist()
            held += piece.column("__held__").to_pylist()
            size += len(w)
            if size >= CHUNK_TOKENS:
                yield ids, np.array(held, bool), *joined()
                ids, held, size = [], [], 0
                pa.default_memory_pool().release_unused()
    if ids:
        yield ids, np.array(held, bool), *joined()


def _heavy_words(source: DataFrame) -> tuple[np.ndarray, int]:
    """(all words with over 1 / (8 * ranges) of the tokens, and some with over half of that: at most 16 * ranges words; ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACE_BYTES)
        for batch in batches:
            for piece in pieces(batch, "__text__"):
                _, w, _ = tokens(hasher, piece.column("__text__"))
                w = np.sort(w)
                first = _starts(w)
                n = np.diff(np.append(first, len(w)))
                often = n * 16 * MOST_RANGES >= len(w)
                yield pa.RecordBatch.from_arrays([pa.array(w[first][often].view(np.int64)), pa.array(n[often]), pa.array(np.where(np.arange(often.sum()) == 0, len(w), 0))], names=["w", "n", "all"])

    counted = source.mapInArrow(run, "w long, n long, all long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    counted = materialize(counted, "heavy")
    total = counted.agg(F.sum("all")).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-total // RANGE_TOKENS)))
    heavy = np.array(sorted(r[0] for r in counted.where(F.col("n") * 16 * ranges >= total).select("w").collect()), np.int64).view(np.uint64)
    release(counted)
    return heavy, ranges


_COUNTS = "r int, w binary, k binary, u binary, c binary, big binary"


def _count_messages(source: DataFrame, heavy: np.ndarray, ranges: int) -> DataFrame:
    """Pairs of all documents with their counts in training ones: 0 asks for the totals of a context that only others hold here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, rows, w, u in _chunks(batches):
            pairs = _Pairs(w, u, heavy, ranges)
            trained = np.bincount(np.repeat(np.arange(len(pairs.sizes)), pairs.sizes), ~held[rows[pairs.order]], minlength=len(pairs.sizes)).astype(np.int64)
            for r, a, b in pairs.slices():
                c, big = _small(trained[a:b])
                yield pa.RecordBatch.from_pylist([{"r": r, **pairs.packed(a, b), "c": c, "big": big}], pa.schema([("r", pa.int32()), *((x, pa.binary()) for x in ("w", "k", "u", "c", "big"))]))

    return source.mapInArrow(run, _COUNTS)


def _merged(table: pa.Table, values: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, summed value) of a range's messages, sorted by word and context."""
    w = np.concatenate([np.repeat(np.frombuffer(a, np.uint64), np.frombuffer(k, np.uint32)) for a, k in zip(table["w"].to_pylist(), table["k"].to_pylist(), strict=True)])
    u = np.concatenate([np.frombuffer(x, np.uint64) for x in table["u"].to_pylist()])
    v = np.concatenate([values(i) for i in range(table.num_rows)])
    order = np.lexsort((u, w))
    w, u = w[order], u[order]
    at = _starts(w, u)
    return w[at], u[at], _sums(v[order], at)


_MODEL = T.StructType([T.StructField(n, T.IntegerType()) for n in ("r", "q")] + [T.StructField(n, T.BinaryType()) for n in ("w", "cw", "cont", "u", "cu", "n1", "n2", "n3")] + [T.StructField("s", T.ArrayType(T.LongType()))] + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("hw", "hc", "hn")])


def _arrow_schema(fields: T.StructType) -> pa.Schema:
    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}
    return pa.schema([(f.name, kinds[f.dataType]) for f in fields])


def _count_range(heavy: np.ndarray, parts: int) -> Callable[[pa.Table], pa.Table]:
    """Merge a range: its words' counts (row q = -1, with the statistics), and its contexts by the part that will total them."""

    def run(table: pa.Table) -> pa.Table:
        c, big = table["c"].to_pylist(), table["big"].to_pylist()
        w, u, n = _merged(table, lambda i: _large(c[i], big[i]))
        first = _starts(w)
        words, counts, cont = w[first], _sums(n, first), _sums((n > 0).astype(np.int64), first)
        words, counts, cont = (x[counts > 0] for x in (words, counts, cont))
        hot = np.isin(words, heavy)
        r = table["r"][0].as_py()
        # pairs with count 1..4, tokens; then for the words of this range alone: how many, continuations 1..4 and in all
        stats = [*(int((n == k).sum()) for k in (1, 2, 3, 4)), int(n.sum()), int((~hot).sum()), *(int((cont[~hot] == k).sum()) for k in (1, 2, 3, 4)), int(cont.sum())]
        rows = [{"r": r, "q": -1, "w": words[~hot].tobytes(), "cw": counts[~hot].astype(np.int64).tobytes(), "cont": cont[~hot].astype(np.int64).tobytes(), "s": stats, "hw": words[hot].view(np.int64).tolist(), "hc": counts[hot].tolist(), "hn": cont[hot].tolist()}]
        order = np.argsort(u, kind="stable")
        u, n = u[order], n[order]
        at = _starts(u)
        own = u[at]
        sums = [_sums(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n >= 3)]
        part = (((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(part, np.arange(parts + 1))
        for q in range(parts):
            a, b = edges[q], edges[q + 1]
            if b > a:
                rows.append({"r": r, "q": q, "u": own[a:b].tobytes()} | {name: x[a:b].astype(np.uint32).tobytes() for name, x in zip(("cu", "n1", "n2", "n3"), sums, strict=True)})
        return pa.Table.from_pylist(rows, _arrow_schema(_MODEL))

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The modified Kneser-Ney discounts by count (0, 1, 2, 3 and more); fixed halves where a count of counts is zero."""
    if min(n1, n2, n3, n4) == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.01, [1, 2, 3])])


def _total_contexts(d: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """For one part of the contexts: their totals over all ranges, sent back to each range for the contexts it holds."""

    def run(table: pa.Table) -> pa.Table:
        us = [np.frombuffer(x, np.uint64) for x in table["u"].to_pylist()]
        u = np.concatenate(us)
        order = np.argsort(u, kind="stable")
        at = _starts(u[order])
        known = u[order][at]
        c, n1, n2, n3 = (_sums(np.concatenate([np.frombuffer(x, np.uint32) for x in table[k].to_pylist()]).astype(np.int64)[order], at) for k in ("cu", "n1", "n2", "n3"))
        gamma = np.where(c > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(c, 1), 1.0)
        rows = []
        for r, own in zip(table["r"].to_pylist(), us, strict=True):
            k = np.searchsorted(known, own)
            rows.append({"r": r, "u": own.tobytes(), "c": c[k].astype(np.float64).tobytes(), "g": gamma[k].astype(np.float32).tobytes()})
        return pa.Table.from_pylist(rows, pa.schema([("r", pa.int32()), ("u", pa.binary()), ("c", pa.binary()), ("g", pa.binary())]))

    return run


def _score_messages(source: DataFrame, heavy: np.ndarray, ranges: int, schema: T.StructType, arrow: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for ids, held, rows, w, u in _chunks(batches):
            number += 1
            flags = np.packbits(~held).tobytes()
            lengths = np.bincount(rows, minlength=len(ids))
            yield pa.RecordBatch.from_pylist([{"r": number % ranges, "chunk": number, "ids": ids, "held": held.tolist(), "n": lengths.tolist()}], arrow)
            pairs = _Pairs(w, u, heavy, ranges)
            docs = rows[pairs.order].astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
            to = np.concatenate([[0], np.cumsum(pairs.sizes)])
            for r, a, b in pairs.slices():
                c, big = _small(pairs.sizes[a:b])
                yield pa.RecordBatch.from_pylist([{"r": r, "chunk": number, **pairs.packed(a, b), "c": c, "big": big, "docs": docs[to[a] : to[b]].tobytes(), "wide": docs.itemsize, "train": flags}], arrow)

    return source.mapInArrow(run, schema)


class MappedArrays:
    """Arrays of a model, each written to a scratch file of this task when it is added and read back by mapping; the file goes at the
    end."""

    def __init__(self):
        handle, self._path = tempfile.mkstemp(prefix="model-")
        self._file = os.fdopen(handle, "wb")

    def __enter__(self) -> MappedArrays:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()
        os.unlink(self._path)

    def add(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x
        self._file.write(b"\0" * (-self._file.tell() % 8))
        at = self._file.tell()
        np.ascontiguousarray(x).tofile(self._file)
        self._file.flush()
        return np.memmap(self._path, x.dtype, "r", at, x.shape)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each key."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


_PART = "chunk long, r int, ids array<{id}>, held array<boolean>, n array<long>, docs binary, known binary, base binary, score binary"


def _score_range(stats: dict, arrow: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    d, e = stats["d"], stats["e"]

    def run(messages: pa.Table, model: pa.Table) -> pa.Table:
        out = [{"chunk": m["chunk"], "r": -1, "ids": m["ids"], "held": m["held"], "n": m["n"]} for m in messages.filter(pa.compute.is_valid(messages["ids"])).to_pylist()]
        messages = messages.filter(pa.compute.is_null(messages["ids"]))
        if not messages.num_rows:
            return pa.Table.from_pylist(out, arrow)
        rows = messages.to_pylist()
        sizes = [_large(m["c"], m["big"]) for m in rows]
        docs = [np.frombuffer(m["docs"], np.uint16 if m["wide"] == 2 else np.uint32) for m in rows]
        trains = [np.unpackbits(np.frombuffer(m["train"], np.uint8)).astype(bool)[x] for m, x in zip(rows, docs, strict=True)]
        counts = [np.bincount(np.repeat(np.arange(len(s)), s), t, minlength=len(s)).astype(np.int64) for s, t in zip(sizes, trains, strict=True)]
        w, u, c = _merged(messages, lambda i: counts[i])
        with MappedArrays() as store:
            own = model.filter(pa.compute.is_valid(model["w"]))
            column = lambda k, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in own[k].to_pylist())])
            words = np.concatenate([column("w", np.uint64), stats["hw"]])
            order = np.argsort(words)
            words = store.add(words[order])
            counts, continued = (store.add(np.concatenate([column(k, np.int64), stats[h]])[order]) for k, h in (("cw", "hc"), ("cont", "hn")))
            place, there = _find(words, w)
            cw = np.where(there, counts[place], 0) if len(words) else np.zeros(len(w), np.int64)
            cont = np.where(there, continued[place], 0) if len(words) else np.zeros(len(w), np.int64)
            own = model.filter(pa.compute.is_valid(model["u"]))
            contexts = column("u", np.uint64)
            order = np.argsort(contexts)
            contexts = store.add(contexts[order])
            totals, weights = (store.add(column(k, t)[order]) for k, t in (("c", np.float64), ("g", np.float32)))
            del order, own
            place, there = _find(contexts, u)
            total = np.where(there, totals[place], 0.0) if len(contexts) else np.zeros(len(u))
            there &= total > 0
            total = np.where(there, total, 1.0)
            left = np.where(there, weights[place], 1.0) if len(contexts) else np.ones(len(u))
        lower = np.maximum(cont - e[np.minimum(cont, 3)], 0) / max(stats["T"], 1) + stats["lower_left"] / (stats["V"] + 1)
        score = np.log10(np.where(there, np.maximum(c - d[np.minimum(c, 3)], 0) / total, 0.0) + left * lower)
        base = np.log10((cw + 1) / (stats["N"] + stats["V"] + 1))
        first = _starts(w)
        firsts, known = w[first], np.unique(u)
        # (word, context) as one increasing key, both by their place in this range
        pair = lambda k, v: (k.astype(np.uint64) << np.uint64(32)) | np.searchsorted(known, v).astype(np.uint64)
        keys = pair(np.repeat(np.arange(len(firsts)), np.diff(np.append(first, len(w)))), u)
        for m, s, x in zip(rows, sizes, docs, strict=True):
            own_w = np.repeat(np.frombuffer(m["w"], np.uint64), np.frombuffer(m["k"], np.uint32))
            at = np.searchsorted(keys, pair(np.searchsorted(firsts, own_w), np.frombuffer(m["u"], np.uint64)))
            token = np.repeat(at, s)
            own, back = np.unique(x, return_inverse=True)
            sums = [np.bincount(back, v[token], minlength=len(own)) for v in ((cw > 0).astype(float), base, score)]
            out.append({"chunk": m["chunk"], "r": m["r"], "docs": own.astype(np.uint32).tobytes(), "known": sums[0].astype(np.int64).tobytes(), "base": sums[1].tobytes(), "score": sums[2].tobytes()})
        return pa.Table.from_pylist(out, arrow)

    return run


def _sum_chunk(stats: dict, arrow: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["r"])
        head = rows[0]
        n = len(head["ids"])
        known, base, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for x in rows[1:]:
            at = np.frombuffer(x["docs"], np.uint32)
            known[at] += np.frombuffer(x["known"], np.int64)
            base[at] += np.frombuffer(x["base"], np.float64)
            score[at] += np.frombuffer(x["score"], np.float64)
        return pa.Table.from_arrays([pa.array(head["ids"], arrow.field(0).type), pa.array(head["held"]), pa.array(head["n"], pa.int64()), pa.array(known), pa.array(np.full(n, stats["N"], np.int64)), pa.array(base), pa.array(score)], schema=arrow)

    return run


def score_texts(docs: DataFrame, *, id: str = "doc_id", text: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """``id``, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Tokens are words (A-Z as a-z, cut at ASCII white space) and one end per text; null counts as empty. Rows whose crc32 of the
    id's text modulo ``folds`` is ``held_fold`` are held out of the counts; a null id counts as an empty text. base_score is the
    add-one unigram log10 probability, score that of the bigram model; unseen words share one place beside the V known ones.
    Without training rows both are uniform. Repeated rows are counted and scored each.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    held = F.pmod(F.crc32(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_fold
    source = docs.select(F.col(f"`{id}`").alias("__id__"), held.alias("__held__"), F.col(f"`{text}`").cast("string").alias("__text__"))
    heavy, ranges = _heavy_words(source)
    parts = max(1, ranges // 2)
    model = materialize(_count_messages(source, heavy, ranges).groupBy("r").applyInArrow(_count_range(heavy, parts), _MODEL), "model")
    own = model.where("q = -1")
    sums = [int(r or 0) for r in own.agg(*[F.sum(F.get("s", k)) for k in range(11)]).first()]
    hot = own.select(F.explode(F.arrays_zip("hw", "hc", "hn")).alias("h")).groupBy("h.hw").agg(F.sum("h.hc").alias("c"), F.sum("h.hn").alias("n"))
    # at most 16 * ranges heavy words
    hot_rows = sorted(tuple(r) for r in hot.collect())
    stats = {k: np.array([x[i] for x in hot_rows], np.int64) for i, k in enumerate(("hw", "hc", "hn"))}
    stats["hw"] = stats["hw"].view(np.uint64)
    t = [sums[6 + k] + int((stats["hn"] == k + 1).sum()) for k in range(4)]
    stats |= {"d": discounts(*sums[:4]), "e": discounts(*t), "N": sums[4], "V": sums[5] + len(hot_rows), "T": sums[10]}
    more = max(0, stats["V"] - t[0] - t[1])
    stats["lower_left"] = (stats["e"][1] * t[0] + stats["e"][2] * t[1] + stats["e"][3] * more) / stats["T"] if stats["T"] else 1.0
    contexts = model.where("q >= 0").select("q", "r", "u", "cu", "n1", "n2", "n3").groupBy("q").applyInArrow(_total_contexts(stats["d"]), "r int, u binary, c binary, g binary")
    shards = materialize(own.select("r", "w", "cw", "cont").unionByName(contexts, allowMissingColumns=True), "shards")
    release(model)
    id_type = docs.schema[id].dataType
    sent = T.StructType.fromDDL(f"r int, chunk long, ids array<{id_type.simpleString()}>, held array<boolean>, n array<long>, w binary, k binary, u binary, c binary, big binary, docs binary, wide int, train binary")
    sent_arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in sent])
    messages = _score_messages(source, heavy, ranges, sent, sent_arrow)
    part = T.StructType.fromDDL(_PART.format(id=id_type.simpleString()))
    part_arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in part])
    partial = messages.groupBy("r").cogroup(shards.groupBy("r")).applyInArrow(_score_range(stats, part_arrow), part)
    result = T.StructType.fromDDL(f"`{id}` {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    result_arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in result])
    return partial.groupBy("chunk").applyInArrow(_sum_chunk(stats, result_arrow), result)


def op4_lm_scores(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
