"""Near-duplicate components with SetSketch registers.

A document's set of word shingles is sketched by registers ``floor(1 - log_b(min of Exp(a) hashes))``, truncated to 16 bits:
exponentially spaced minima that merge by maximum and agree with a chance that follows the Jaccard similarity. Bands of
registers propose pairs, a joint maximum-likelihood estimate drops the unlikely ones and the rest are verified on full sets.

Equal sets are one class from the start. First each class is compared with the most central one of its buckets, which joins up a
group of copies without ever making all its pairs; then classes of one bucket that no link has joined are compared in full, so that
no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._arrow import annotate, field, give_back, pieces
from tessera.llm._storage import materialize, release
from tessera.llm._words import SPACE_BYTES, WordHasher, mix64
from tessera.llm.components import connected_components
from tessera.llm.url_filter import build_bloom

#: SetSketch parameters: base, rate and register limit.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
REGISTERS, BANDS, ROWS = 256, 32, 4
#: Pairs estimated this far below the threshold (six standard errors of 256 registers) are not verified.
MARGIN = 0.15
#: Bits of the parity sketch.
PARITY = 2048
MOST_BROADCAST_KEYS = 1 << 16
#: Pairs verified at a time, of some ten thousand bytes each.
_PAIR_ROWS = 1000


def shingle_sets(rows: np.ndarray, words: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the distinct ``size``-word shingles, sorted by both; a shorter row has its whole sequence as one."""
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    parts_row, parts = [], []
    if len(words) >= size:
        h = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            h = mix64(h) + words[k : len(words) - size + 1 + k]
        same = rows[: len(h)] == rows[size - 1 :]
        parts_row.append(rows[: len(h)][same])
        parts.append(mix64(h[same] ^ np.uint64(size)))
    for length in range(1, size):
        short = np.flatnonzero(count == length)
        if len(short):
            h = words[first[short]].copy()
            for k in range(1, length):
                h = mix64(h) + words[first[short] + k]
            parts_row.append(short)
            parts.append(mix64(h ^ np.uint64(length)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, h = np.concatenate(parts_row), np.concatenate(parts)
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


class SetSketch:
    def __init__(self, registers: int):
        seeds = mix64(np.arange(1, 2 * registers + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.flips, self.factors = seeds[:registers], seeds[registers:] | np.uint64(1)

    def registers(self, sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of uint16 registers for each non-empty set; ``sets`` holds them end to end."""
        out = np.empty((len(starts), len(self.flips)), np.uint64)
        for k, (flip, factor) in enumerate(zip(self.flips, self.factors, strict=True)):
            out[:, k] = np.minimum.reduceat((sets ^ flip) * factor, starts)
        least = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64) / RATE
        return np.clip(np.floor(1 - np.log(np.maximum(least, 1e-300)) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def parity_sketches(row: np.ndarray, sets: np.ndarray, n: int) -> np.ndarray:
    """Per row ``PARITY`` bits, each the parity of the shingles that fall on it. Two rows' bits differ in at most as many places
    as their sets differ in shingles, so they rule out links without ever ruling out a true one."""
    bit = (mix64(sets ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(PARITY - 1)).astype(np.int64)
    odd = np.bincount(row * PARITY + bit, minlength=n * PARITY).reshape(n, PARITY) & 1
    return np.packbits(odd.astype(bool), axis=1)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard estimates of register rows, the set sizes known."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - above - below
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * top
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = np.maximum(p(u - v * grid), 1e-12), np.maximum(p(v - u * grid), 1e-12)
    score = above * np.log(more) + below * np.log(less) + equal * np.log(np.maximum(1 - more - less, 1e-12))
    return np.take_along_axis(grid, score.argmax(1)[:, None], 1)[:, 0]


def _sketcher(size: int) -> Callable[[], Callable[[pa.Array], list]]:
    def make():
        hasher, sketch = WordHasher(SPACE_BYTES), SetSketch(REGISTERS)

        def run(texts: pa.Array) -> list:
            n = len(texts)
            row, sets = shingle_sets(*hasher.words(texts), n, size)
            count = np.bincount(row, minlength=n)
            filled = np.flatnonzero(count)
            starts = (np.cumsum(count) - count)[filled]
            digests = np.zeros((2, n), np.uint64)
            registers: list[bytes | None] = [None] * n
            odd = np.concatenate([np.zeros((0, PARITY // 8), np.uint8), *(parity_sketches(row[(row >= k) & (row < k + 1024)] - k, sets[(row >= k) & (row < k + 1024)], min(1024, n - k)) for k in range(0, n, 1024))])
            if len(filled):
                digests[0, filled] = np.add.reduceat(mix64(sets), starts)
                digests[1, filled] = np.add.reduceat(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), starts)
                for k, r in zip(filled.tolist(), sketch.registers(sets, starts), strict=True):
                    registers[k] = r.tobytes()
            return [count.tolist(), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), registers, [x.tobytes() for x in odd]]

        return run

    return make


def _set_writer(size: int) -> Callable[[], Callable[[pa.Array], list]]:
    def make():
        hasher = WordHasher(SPACE_BYTES)

        def run(texts: pa.Array) -> list:
            n = len(texts)
            row, sets = shingle_sets(*hasher.words(texts), n, size)
            count = np.bincount(row, minlength=n)
            to = np.cumsum(count)
            digests = np.zeros((2, n), np.uint64)
            filled = np.flatnonzero(count)
            if len(filled):
                starts = (to - count)[filled]
                digests[0, filled] = np.add.reduceat(mix64(sets), starts)
                digests[1, filled] = np.add.reduceat(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), starts)
            return [pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), [sets[b - c : b].tobytes() for b, c in zip(to, count, strict=True)]]

        return run

    return make


def _cells(classes: DataFrame) -> DataFrame:
    """(bucket, node, n): a class's band values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS)
                regs = regs[:, : BANDS * ROWS].reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
                h = np.broadcast_to(salt, regs.shape[:2]).copy()
                for k in range(ROWS):
                    h = mix64(h ^ regs[:, :, k])
                each = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), BANDS))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), each("node"), each("n")], names=["bucket", "node", "n"])

    return classes.select("node", "n", "registers").mapInArrow(run, "bucket long, node long, n long")


def _linked(percent: int) -> Callable:
    @F.pandas_udf(T.BooleanType())
    def run(r_a: pd.Series, r_b: pd.Series, s_a: pd.Series, s_b: pd.Series) -> pd.Series:
        """Whether the estimate allows the threshold and the full sets reach it."""
        out = np.zeros(len(r_a), bool)
        if len(out):
            sizes = [np.array([len(x) // 8 for x in s], np.float64) for s in (s_a, s_b)]
            registers = [np.frombuffer(b"".join(r), np.uint16).reshape(len(out), -1) for r in (r_a, r_b)]
            for k in np.flatnonzero(estimate(*registers, *sizes) >= percent / 100 - MARGIN):
                both = len(np.intersect1d(np.frombuffer(s_a[k], np.uint64), np.frombuffer(s_b[k], np.uint64), assume_unique=True))
                out[k] = both * 100 >= percent * (sizes[0][k] + sizes[1][k] - both)
            del registers
            give_back()
        return pd.Series(out)

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the proposed (a, b) those that reach the threshold."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("registers").alias(f"r{s}"), F.col("shingles").alias(f"s{s}"))
    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(_linked(percent)("ra", "rb", "sa", "sb")).select("a", "b")


def _fits(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the threshold."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most ``MOST_BROADCAST_KEYS`` rows (of a few numbers)."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST_KEYS + 1).count() <= MOST_BROADCAST_KEYS else df


def _with_sets(docs: DataFrame, id: str, text: str, classes: DataFrame, size: int) -> DataFrame:
    """``classes`` with ``shingles``, from a second reading of the documents that stand for them. A filter of fixed size leaves out most
    others before their texts are read into sets."""
    key = lambda c: F.xxhash64(c.cast("string"))
    known = build_bloom(classes.select(key(F.col("low")).alias("key")), "key", 1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = _set_writer(size)()
        for batch in batches:
            wanted = known.contains(batch.column(0).to_numpy().view(np.uint64))
            for piece in pieces(batch.filter(pa.array(wanted)), 1):
                d1, d2, sets = write(piece.column(1))
                yield pa.RecordBatch.from_arrays([d1, d2, pa.array(sets, pa.binary())], names=["d1", "d2", "shingles"])
            give_back()

    found = docs.select(key(F.col(id)), F.col(text).cast("string")).mapInArrow(run, "d1 long, d2 long, shingles binary")
    one = found.join(_small(classes.select("d1", "d2")), ["d1", "d2"], "left_semi").groupBy("d1", "d2").agg(F.any_value("shingles").alias("shingles"))
    return classes.join(one, ["d1", "d2"])


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id``, n_shingles, component_id (least id reachable over links, its own included), kept.

    Words are runs without ASCII white space, A-Z as a-z; a document's set is its distinct ``size``-word shingles, or its whole
    sequence if it is shorter. Two documents are linked if 100 * intersection >= ``percent`` * union. Null, empty and blank
    texts have no set, are linked with nothing and are kept. ``kept`` holds where id = component_id (repeated rows with that id
    are all kept). Rows with a null id belong to the component of their set; its id ignores nulls. An empty table gives none.
    """
    fields = [field("n", "long"), field("d1", "long"), field("d2", "long"), field("registers", "binary"), field("odd", "binary")]
    source = docs.select(F.col(f"`{id}`").alias("__id__"), F.col(f"`{text}`").alias("__text__"))
    rows = materialize(annotate(source, "__text__", _sketcher(size), fields, ["__id__"]).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    filled = rows.where("n > 0")
    classes = materialize(filled.groupBy("d1", "d2").agg(F.min("uid").alias("node"), F.min("__id__").alias("low"), F.any_value("registers").alias("registers"), F.any_value("odd").alias("odd"), F.any_value("n").alias("n")), "classes")
    owned = _component_of(source, "__id__", "__text__", classes, size, percent)
    lows = owned.join(classes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("component_id"))
    named = materialize(owned.join(lows, "component").select("node", "component", "component_id"), "named")
    lowest = classes.select("d1", "d2", "node", "low").join(_small(named), "node", "left").select("d1", "d2", F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    linked = filled.select("__id__", "n", "d1", "d2").join(lowest, ["d1", "d2"]).select("__id__", "n", "component_id")
    alone = rows.where("n = 0").select("__id__", "n", F.col("__id__").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select(F.col("__id__").alias(id), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("__id__") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component (its least id) and all that are linked with nothing.

    Rows that share id and text are one document; rows that share an id but not the text are each judged as part of that id's
    component. Null, empty and blank texts are all kept, also with a null id; an empty table stays empty; columns stay as they are,
    whatever their names.
    """
    judged = materialize(near_duplicates(docs, id=id, text=text, size=size, percent=percent), "judged")
    own, again = (_free(docs, c) for c in ("__id__", "__text__"))
    kept = judged.where("kept").groupBy(F.col(id).alias(own)).agg((F.count("*") > 1).alias("several"), (F.max("n_shingles") > 0).alias("filled"))
    kept = materialize(kept, "kept")
    same = lambda df, ids: df[f"`{id}`"].eqNullSafe(ids[own])
    ids = _small(kept.select(own))
    out = docs.join(ids, same(docs, ids), "left_semi")
    twice = kept.where("several and filled").select(own)
    if twice.isEmpty():
        return out
    several = out.join(twice, same(out, twice), "left_semi").withColumn(again, F.xxhash64(F.col(f"`{text}`"))).dropDuplicates([id, again]).drop(again)
    return out.join(twice, same(out, twice), "left_anti").unionByName(several)


def _free(df: DataFrame, name: str) -> str:
    """The name, longer where the table has a column of it."""
    while name in df.columns:
        name += "_"
    return name


def _signed(classes: DataFrame) -> DataFrame:
    """(node, n, sig, odd) in longs, so that a join can compare sketches by itself: the low four bits of a mixed register each,
    and the parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = lambda x, n: pa.FixedSizeListArray.from_arrays(pa.array(x), n).cast(pa.list_(pa.int64()))
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, 16).astype(np.uint64)
                sig = np.bitwise_or.reduce((mix64(regs) & np.uint64(15)) << np.arange(0, 64, 4, dtype=np.uint64), axis=1).view(np.int64)
                odd = np.frombuffer(b"".join(batch.column("odd").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), longs(sig, REGISTERS // 16), longs(odd, PARITY // 64)], names=["node", "n", "sig", "odd"])

    return classes.select("node", "n", "registers", "odd").mapInArrow(run, "node long, n long, sig array<long>, odd array<long>")


def _could_link(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the threshold, parity bits that allow the difference it allows (at most that many places, and no more
    than six deviations over what it would flip), and registers within ``MARGIN``: those differ in 15 of 16 cases."""
    fits = _fits(f"{a}.n", f"{b}.n", percent)
    both = lambda name, k: F.col(f"{a}.{name}")[k].bitwiseXOR(F.col(f"{b}.{name}")[k])
    allowed = (F.col(f"{a}.n") + F.col(f"{b}.n")) * ((100 - percent) / (100 + percent))
    flipped = reduce(lambda x, y: x + y, [F.bit_count(both("odd", k)) for k in range(PARITY // 64)])
    expected = PARITY / 2 * (1 - F.exp(-2 * allowed / PARITY))

    def differing(k: int) -> Column:
        x = both("sig", k)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    total = reduce(lambda x, y: x + y, map(differing, range(REGISTERS // 16)))
    return fits & (flipped <= F.least(allowed + 1e-6, expected + 3 * PARITY**0.5)) & (total <= int(REGISTERS * (1 - percent / 100 + MARGIN) * 15 / 16))


def _component_of(docs: DataFrame, id: str, text: str, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have a link."""
    cells = _cells(classes)
    several = cells.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    shared = materialize(cells.join(several, "bucket"), "cells")
    central = shared.groupBy("node").agg(F.sum("c").alias("central"))
    nodes = materialize(_with_sets(docs, id, text, classes.join(central, "node").select("node", "central", "n", "d1", "d2", "low", "registers", "odd"), size), "nodes")
    # the most central class of a bucket is near what a group was copied from
    ranked = shared.join(central, "node").groupBy("bucket").agg(F.max(F.struct("central", "node", F.col("n").alias("m"))).alias("top")).select("bucket", "top.node", "top.m").withColumnRenamed("node", "pivot")
    stars = shared.join(ranked, "bucket").where((F.col("node") != F.col("pivot")) & _fits("n", "m", percent))
    found = materialize(_verified(stars.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")), nodes, percent), "links", _PAIR_ROWS)
    joined = connected_components(found)

    labelled = shared.join(_small(joined), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    labelled = materialize(labelled, "labelled")
    split = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    left = materialize(labelled.join(split, "bucket").join(_signed(nodes), "node").select("bucket", "component", F.struct("node", "n", "sig", "odd").alias("x")), "apart")
    other = left.select("bucket", F.col("x").alias("y"), F.col("component").alias("other"))
    near = (F.col("component") != F.col("other")) & (F.col("x.node") < F.col("y.node")) & _could_link("x", "y", percent)
    pairs = left.join(other, "bucket").where(near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = materialize(_verified(pairs, nodes, percent), "links", _PAIR_ROWS)
    release(left, labelled, shared)
    return connected_components(found.union(more))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


OP9_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS k FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN n USING (doc_id)
"""
