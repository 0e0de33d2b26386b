"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table: for each block of documents and each term one posting list, the term's sorted word positions in
the block. Blocks bound a list's length, so a frequent term is many lists and no task ever holds all of it. Only terms that a filter
of fixed size knows from the benchmark are stored.

A benchmark window is routed to the blocks that hold its rarest term (for near matches, which may lack some terms, one of as many
more of its rarest terms). There the lists of its terms, shifted by their offsets, are intersected from the rarest on until none or
all are left. Windows are a distributed table too: neither they nor the items ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._arrow import give_back, pieces
from tessera.llm._storage import materialize
from tessera.llm._words import NON_ALNUM_BYTES, WordHasher, mix64
from tessera.llm.url_filter import BlockedBloom, build_bloom

#: Positions between two documents of a block, more than any window with its slack reaches over.
_GAP = 64
_POSITION_BITS = 40
_CANDIDATES = 1 << 21
#: Bytes of text to a block of documents; a document is never cut.
BLOCK_BYTES = 1 << 24
#: Windows that one task intersects with a block.
MOST_WINDOWS = 1 << 18
MOST_BROADCAST_KEYS = 1 << 16


class Postings:
    """The posting lists of a block's terms as one sorted array of (term, position)."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        """``terms`` sorted; ``positions`` holds their lists end to end."""
        self.counts = np.append(counts, 0)  # the last stands for all terms that aren't there
        self.terms = terms
        self.first = np.cumsum(self.counts) - self.counts
        self.keys = (np.repeat(np.arange(len(terms)), counts) << _POSITION_BITS) | positions

    def ids(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, len(self.terms))

    def near(self, term: np.ndarray, position: np.ndarray, slack: int) -> np.ndarray:
        """Whether the term occurs within ``slack`` of the position."""
        low = (term << _POSITION_BITS) + np.maximum(position - slack, 0)
        at = np.searchsorted(self.keys, low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= (term << _POSITION_BITS) + position + slack)

    def _in_place(self, windows: np.ndarray, order: np.ndarray, win: np.ndarray, start: np.ndarray, ranks: Iterable[int], slack: int, misses: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates with all but ``misses`` of the terms of these ranks within ``slack`` of their place."""
        bad = np.zeros(len(win), np.int64)
        for k in ranks:
            off = order[win, k]
            bad += ~self.near(windows[win, off], start + off, slack)
            left = bad <= misses
            win, start, bad = win[left], start[left], bad[left]
            if not len(win):
                break
        return win, start

    def _around(self, windows: np.ndarray, order: np.ndarray, rank: int, slack: int, misses: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates with the term of this rank in its place, some at a time."""
        anchor = windows[np.arange(len(windows)), order[:, rank]]
        load = self.counts[anchor]
        edges = np.searchsorted(np.cumsum(load), np.arange(0, load.sum() + _CANDIDATES, _CANDIDATES))
        for a, b in zip(edges[:-1], [*edges[1:-1], len(windows)], strict=True):
            n = load[a:b]
            if not n.sum():
                continue
            win = np.repeat(np.arange(a, b), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = (self.keys[self.first[anchor[win]] + within] & ((1 << _POSITION_BITS) - 1)) - order[win, rank]
            yield self._in_place(windows, order, win, start, (k for k in range(windows.shape[1]) if k != rank), slack, misses)

    def find(self, windows: np.ndarray, slack: int = 0, misses: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of each occurrence of the windows (term ids): all terms in place, or all but ``misses`` within ``slack``
        of their place."""
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        df = self.counts[windows]
        alive = np.flatnonzero((df == 0).sum(1) <= misses)
        if len(self.keys) and len(alive):
            windows = windows[alive]
            order = np.argsort(np.where(df == 0, np.iinfo(np.int64).max, df)[alive], axis=1, kind="stable")
            # of one term more than may be missing, one is there; around it, all others lie within twice the slack
            for rank in range(misses + 1):
                for win, start in self._around(windows, order, rank, 2 * slack, misses):
                    if slack:
                        win, start = np.unique(np.stack([win, start]), axis=1)
                        win, start = np.repeat(win, 2 * slack + 1), (start[:, None] + np.arange(-slack, slack + 1)).ravel()
                        win, start = self._in_place(windows, order, win, start, range(windows.shape[1]), slack, misses)
                    out.append((alive[win], start))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def benchmark_windows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(item, window, terms): each ``size`` consecutive words of an item, or all of a shorter item's; ``window`` is a 64-bit hash of
    them. Items without an id or words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(NON_ALNUM_BYTES)
        for batch in batches:
            for piece in pieces(batch, "__text__", 1 << 20):
                rows, words = hasher.words(piece.column("__text__"))
                count = np.bincount(rows, minlength=piece.num_rows)
                length = np.minimum(count, size)
                windows = np.where(count > 0, count - length + 1, 0)
                owner = np.repeat(np.arange(piece.num_rows), windows)
                start = np.repeat(np.cumsum(count) - count, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                n = length[owner]
                digest = mix64(n.astype(np.uint64))
                for k in range(size):
                    more = n > k
                    digest[more] = mix64(digest[more]) + words[start[more] + k]
                ends = np.concatenate([[0], np.cumsum(n)])
                terms = words[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])]
                yield pa.RecordBatch.from_arrays([piece.column("item").take(pa.array(owner)), pa.array(mix64(digest).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms.view(np.int64)))], names=["item", "window", "terms"])

    source = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("__text__")).where("item is not null and __text__ is not null")
    return source.mapInArrow(run, "item string, window long, terms array<long>")


def positional_index(docs: DataFrame, text: str, keep: list[str], known: BlockedBloom) -> DataFrame:
    """One table of three kinds of rows by block of documents. 0: a document (``keep`` columns, ``row`` in its block, ``n`` words).
    1: a posting list (``term``, ``n`` positions, ``posts``). 2: the first position of each document of the block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text__"))
    own = [T.StructField("__kind__", T.IntegerType()), T.StructField("__block__", T.LongType()), T.StructField("__row__", T.IntegerType()), T.StructField("__term__", T.LongType()), T.StructField("__n__", T.LongType()), T.StructField("__posts__", T.BinaryType())]
    schema = T.StructType([*(T.StructField(c, source.schema[c].dataType, True) for c in keep), *own])
    arrow = to_arrow_schema(schema)

    def rows_of(kind: int, block: int, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        columns = columns | {"__kind__": pa.array(np.full(n, kind, np.int32)), "__block__": pa.array(np.full(n, block, np.int64))}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, block = WordHasher(NON_ALNUM_BYTES), TaskContext.get().partitionId() << 32
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        firsts: list[np.ndarray] = []
        held = documents = 0
        words_so_far = 0

        def lists() -> Iterator[pa.RecordBatch]:
            words, positions = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.argsort(words, kind="stable")
            words, positions = words[order], positions[order]
            at = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
            ends = np.append(at, len(words)).astype(np.int32)
            posts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends * np.int32(4)), pa.py_buffer(positions)])
            yield rows_of(1, block, len(at), {"__term__": pa.array(words[at].view(np.int64)), "__n__": pa.array(np.diff(ends)), "__posts__": posts})
            yield rows_of(2, block, 1, {"__n__": pa.array([documents]), "__posts__": pa.array([np.concatenate(firsts).tobytes()], pa.binary())})

        for batch in batches:
            for piece in pieces(batch, "__text__"):
                rows, words = hasher.words(piece.column("__text__"))
                n = piece.num_rows
                count = np.bincount(rows, minlength=n)
                # documents lie a gap apart, the first one too
                firsts.append((words_so_far + np.cumsum(count) - count + (documents + 1 + np.arange(n)) * _GAP).astype(np.uint32))
                chosen = np.flatnonzero(known.contains(words))
                kept.append((words[chosen], (words_so_far + chosen + (documents + 1 + rows[chosen]) * _GAP).astype(np.uint32)))
                yield rows_of(0, block, n, {c: piece.column(c) for c in keep} | {"__row__": pa.array(np.arange(documents, documents + n)), "__n__": pa.array(count)})
                words_so_far += len(words)
                documents += n
                held += piece.column("__text__").nbytes
                if held >= BLOCK_BYTES:
                    yield from lists()
                    give_back()
                    block += 1
                    kept, firsts = [], []
                    held = documents = words_so_far = 0
        if documents:
            yield from lists()
        kept = firsts = None
        give_back()

    return source.mapInArrow(run, schema)


def _routes(windows: DataFrame, lists: DataFrame, misses: int) -> DataFrame:
    """(window, terms, block): the blocks that hold one of the rarest terms of a window. A window with more terms unknown to the corpus
    than may be missing has none."""
    counts = lists.groupBy("term").agg(F.sum("n").alias("c"))
    places = windows.select("window", F.size("terms").alias("size"), F.explode("terms").alias("term")).join(counts, "term", "left")
    rare = places.groupBy("window").agg(F.max("size").alias("size"), F.count("c").alias("there"), F.sort_array(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "term")))).alias("rare"))
    allowed = F.when(F.col("size") > 2 * misses, misses).otherwise(0)
    more = allowed - (F.col("size") - F.col("there")) + 1
    anchors = rare.where(more > 0).select("window", F.explode(F.slice("rare", F.lit(1), more)).alias("x")).select("window", F.col("x.term").alias("term")).distinct()
    return anchors.join(lists.select("term", "block"), "term").select("window", "block").distinct().join(windows, "window")


_MATCHES = "block long, row int, window long, start long, size int, near boolean"


def _matcher(slack: int, misses: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(index: pa.Table, routed: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {k: [np.zeros(0, np.int64)] for k in ("row", "window", "start", "size", "near")}
        block = 0
        if index.num_rows and routed.num_rows:
            block = index["block"][0].as_py()
            first = np.frombuffer(index.filter(pa.compute.equal(index["kind"], 2))["posts"][0].as_py(), np.uint32).astype(np.int64)
            lists = index.filter(pa.compute.equal(index["kind"], 1))
            lists = lists.take(pa.compute.sort_indices(lists["term"]))
            terms = lists["term"].to_numpy()
            positions = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.uint32) for x in lists["posts"].to_pylist())]).astype(np.int64)
            postings = Postings(terms, lists["n"].to_numpy(), positions)
            sizes = pa.compute.list_value_length(routed["terms"]).to_numpy()
            for size in np.unique(sizes).tolist():
                own = routed.filter(pa.array(sizes == size))
                names = own["window"].to_numpy()
                shapes = postings.ids(pa.compute.list_flatten(own["terms"]).to_numpy().reshape(-1, size))
                for near in (False, True):
                    if near and (not misses or size <= 2 * misses):
                        continue
                    win, start = postings.find(shapes, slack, misses) if near else postings.find(shapes)
                    row = np.searchsorted(first, start + (size - 1 if near else 0), "right") - 1
                    if near:
                        win, row = np.unique(np.stack([win, np.maximum(row, 0)]), axis=1)
                        start = np.zeros_like(row)
                    for k, x in (("row", row), ("window", names[win]), ("start", start), ("size", np.full(len(row), size)), ("near", np.full(len(row), near))):
                        out[k].append(x)
        columns = {k: np.concatenate(x) for k, x in out.items()}
        postings = lists = positions = None
        give_back()
        n = len(columns["row"])
        return pa.Table.from_arrays([pa.array(np.full(n, block, np.int64)), pa.array(columns["row"].astype(np.int32)), pa.array(columns["window"]), pa.array(columns["start"]), pa.array(columns["size"].astype(np.int32)), pa.array(columns["near"].astype(bool))], names=["block", "row", "window", "start", "size", "near"])

    return run


def _search(docs: DataFrame, benchmark: DataFrame, text: str, item: str, keep: list[str], window: int, slack: int, misses: int, filter_blocks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their place and number of words, matches, (item, window)); all are written tables."""
    listed = materialize(benchmark_windows(benchmark, item, text, window), "windows")
    windows = listed.dropDuplicates(["window"]).select("window", "terms")
    known = build_bloom(listed.select(F.explode("terms").alias("term")).distinct(), "term", filter_blocks)
    index = materialize(positional_index(docs, text, keep, known), "postings")
    documents = index.where("__kind__ = 0").select(*[F.col(f"`{c}`") for c in keep], F.col("__block__"), F.col("__row__"), F.col("__n__").alias("n_words"))
    stored = index.where("__kind__ > 0").select(F.col("__kind__").alias("kind"), F.col("__block__").alias("block"), F.col("__term__").alias("term"), F.col("__n__").alias("n"), F.col("__posts__").alias("posts"))
    parts = -(-windows.count() // MOST_WINDOWS) or 1
    routed = _routes(windows, stored.where("kind = 1"), misses).withColumn("part", F.pmod("window", F.lit(parts)))
    shards = stored.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    found = shards.groupBy("block", "part").cogroup(routed.groupBy("block", "part")).applyInArrow(_matcher(slack, misses), _MATCHES)
    return documents, materialize(found, "matches"), listed.select("item", "window").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", window: int = 10, slack: int = 2, misses: int = 2, filter_blocks: int = 1 << 12) -> DataFrame:
    """Per document: n_words, n_hit (words in an occurring window), n_items, items (ids, sorted as strings), n_near_items.

    Words are maximal runs of letters, digits and non-ASCII characters, A-Z as a-z. An item counts as near if a window of it (of
    over twice ``misses`` words) occurs with all but ``misses`` words within ``slack`` of their place, or occurs. Null and empty
    texts have no words; benchmark rows without an id or words match nothing; rows of one item id are one item; repeated documents
    are each reported. An empty benchmark hits nothing. A kept column named like a result is replaced by it.

    ``filter_blocks`` fixes the filter of benchmark terms at 64 bytes each, whatever the benchmark; a fuller one only lets more
    terms into the index.
    """
    made = ("n_words", "n_hit", "n_items", "items", "n_near_items")
    keep = [c for c in keep if c not in made]
    documents, matches, listed = _search(docs, benchmark, text, item, keep, window, slack, misses, filter_blocks)
    before = F.max(F.col("start") + F.col("size")).over(Window.partitionBy("block", "row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    to = F.col("start") + F.col("size")
    covered = matches.where("not near").withColumn("new", F.greatest(F.lit(0), to - F.greatest("start", F.coalesce(before, F.col("start")))))
    hits = covered.groupBy("block", "row").agg(F.sum("new").cast("long").alias("n_hit"))
    owners = matches.select("block", "row", "window", "near").distinct().join(listed, "window").groupBy("block", "row", "item").agg(F.max(~F.col("near")).alias("exact"))
    items = owners.groupBy("block", "row").agg(F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count("*").alias("n_near_items"))
    places = hits.join(items, ["block", "row"], "full").withColumnsRenamed({"block": "__block__", "row": "__row__"})
    out = documents.join(places, ["__block__", "__row__"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(*[F.col(f"`{c}`") for c in keep], "n_words", zero(F.col("n_hit")).alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"), zero(F.col("n_near_items")).alias("n_near_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark.

    Rows with one text share their fate, whatever their ids. Null and empty texts stay, an empty benchmark drops nothing, an empty
    table stays empty, and columns stay as they are. Texts are told apart by two 64-bit hashes; those of contaminated texts are
    broadcast up to 65,536, beyond that joined by shuffle.
    """
    marks = [F.xxhash64(F.col(f"`{text}`"), F.lit(k)).alias(f"__mark{k}__") for k in range(2)]
    documents, matches, _ = _search(docs.select(*marks, F.col(f"`{text}`")), benchmark, text, item, ["__mark0__", "__mark1__"], window, 0, 0, 1 << 12)
    hit = matches.select(F.col("block").alias("__block__"), F.col("row").alias("__row__")).distinct()
    hit = materialize(documents.join(hit, ["__block__", "__row__"], "left_semi").select("__mark0__", "__mark1__").distinct(), "contaminated")
    small = hit.limit(MOST_BROADCAST_KEYS + 1).count() <= MOST_BROADCAST_KEYS
    same = [own == hit[f"__mark{k}__"] for k, own in enumerate(F.xxhash64(docs[f"`{text}`"], F.lit(k)) for k in range(2))]
    return docs.join(F.broadcast(hit) if small else hit, same[0] & same[1], "left_anti")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS win, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, k, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
