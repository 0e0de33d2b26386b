"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slots are golden-ratio points mapped through the sources' cumulative shares, so every prefix of the schedule holds each source
close to its share. A slot's rank within its source names the block it plays: a source's documents, in a seeded shuffled
order, are one stream of words cut into blocks of equal length, played round after round.

Ranks and stream offsets are prefix sums. Each is taken in two steps (chunks of a key, then inside a chunk), so no task ever
holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._storage import materialize

_SPACES = " \t\n\u000b\f\r"
_WORD = r"[ \t\n\x0B\f\r]*+[^ \t\n\x0B\f\r]++"
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.length(F.rtrim(F.regexp_replace(text, _WORD, "x"), F.lit(_SPACES))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """(place, source, source_size, docs, target) from (source, source_size, docs): sources by code point, null last, weigh 1,
    2, 3, repeating, and share the total; a target stops at ``most`` times its source's size and the excess goes to the others
    by weight. One row per source; the windows run over these rows alone.

    With sources ordered by limit / weight, the first k are full and the rest share what is left at one level: the level of
    the first k for which the next source isn't full.
    """
    name = [F.col("source").isNull(), F.encode(F.col("source"), "utf-8")]
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(*name)) - 1)
    weighed = placed.withColumn("weight", (F.col("place") % 3 + 1).cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    leveled = weighed.withColumn("level", left / F.sum("weight").over(after))
    level = F.first(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")), ignorenulls=True).over(whole)
    return leveled.withColumn("target", F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))).select("place", "source", "source_size", "docs", "target")


def _prefix(df: DataFrame, keys: list[str], chunk: str, order: list, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same keys that come before: chunk by chunk, then inside the chunk."""
    own = df.withColumn("__v__", value)
    totals = own.groupBy(*keys, chunk).agg(F.sum("__v__").alias("__t__"))
    across = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, chunk, F.coalesce(F.sum("__t__").over(across), F.lit(0)).alias("__s__"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("__i__", F.coalesce(F.sum("__v__").over(inside), F.lit(0))).join(starts, [*keys, chunk]).withColumn(name, F.col("__s__") + F.col("__i__")).drop("__v__", "__i__", "__s__")


def mix_sources(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, block_words: int = 4096, least_blocks: int = 1024, seed: int = 7, chunk_rows: int = 1 << 12, most_broadcast_sources: int = 1 << 14) -> DataFrame:
    """One row per document: ``id``, source, size, source_size, target, taken (words the mix takes of it, repeats counted).

    Null texts have size 0. Sources need not be known beforehand; null is one. Sources without words have target 0. Documents of
    one id and size are interchangeable. The table of sources is broadcast up to ``most_broadcast_sources`` rows, beyond that it is
    joined by shuffle. No document is taken over ``most`` times, and reruns agree.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("key")
    rows = docs.select(F.col(f"`{id}`").alias("__id__"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    rows = materialize(rows.select("*", key), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    length = F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr(f"source_size div {least_blocks}"))).cast("long")
    targets = source_targets(sizes, most).select("*", key, length.alias("length"))
    targets = targets.withColumn("blocks", F.expr("(source_size + length - 1) div length")).withColumn("slots", F.round(F.col("target") / F.col("length")))
    by_place = Window.orderBy("place")
    targets = materialize(targets.withColumn("hi", F.sum("slots").over(by_place)).withColumn("lo", F.col("hi") - F.col("slots")), "targets")
    total, sources = (int(x or 0) for x in targets.agg(F.max("hi"), F.count("*")).first())
    small = sources <= most_broadcast_sources

    # slots: a point finds its source through a grid of cells, an equi-join however many sources there are
    cells = max(16, 4 * sources)
    cell = lambda x: F.least(F.lit(cells - 1), F.floor(x * F.lit(cells / max(total, 1))).cast("long"))
    grid = targets.where("slots > 0").select("place", "lo", "hi", "blocks", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    point = (F.col("id") + 0.5) * F.lit(GOLDEN)
    slots = spark.range(total).withColumn("x", (point - F.floor(point)) * total).withColumn("cell", cell(F.col("x")))
    played = slots.join(F.broadcast(grid) if small else grid, "cell").where("x >= lo and x < hi").select("id", "place", "blocks", F.expr(f"id div {chunk_rows}").alias("chunk"))
    ranked = _prefix(played, ["place"], "chunk", ["id"], F.lit(1), "rank")
    plays = ranked.where(F.col("rank") < F.col("blocks") * most).groupBy("place", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("plays"))

    # documents: place in the shuffled stream of their source, then the blocks they lie in
    known = targets.select("key", "place", "source_size", "docs", "length", "target")
    owned = rows.join(F.broadcast(known) if small else known, "key").drop("key")
    shuffled = owned.where("size > 0").withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__id__").cast("string"))))
    leading = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 2.0**32
    shuffled = shuffled.withColumn("chunk", F.floor(leading * F.ceil(F.col("docs") / chunk_rows)).cast("long"))
    streamed = _prefix(shuffled, ["place"], "chunk", ["order", F.col("__id__").cast("string"), "size"], F.col("size"), "at")
    pieces = streamed.withColumn("block", F.explode(F.sequence(F.expr("at div length"), F.expr("(at + size - 1) div length"))))
    inside = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("length")) - F.greatest("at", F.col("block") * F.col("length"))
    joined = pieces.join(plays, ["place", "block"], "left").withColumn("words", inside * F.coalesce("plays", F.lit(0)))
    taken = joined.groupBy("place", "at", "__id__", "source", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken"))
    out = ["__id__", "source", "size", "source_size", "target", "taken"]
    empty = owned.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*out).unionByName(empty.select(*out)).withColumnRenamed("__id__", id)


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM s),
v AS (SELECT *, (place % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
f AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, place, least(cap, coalesce(f.level * weight, cap)) AS target, greatest(1, least(4096, source_size // 1024)) AS len FROM v LEFT JOIN f ON true),
b AS (SELECT *, (source_size + len - 1) // len AS blocks, round(target / len) AS slots FROM t),
r AS (SELECT *, sum(slots) OVER (ORDER BY place) AS hi, sum(slots) OVER (ORDER BY place) - slots AS lo FROM b),
x AS (SELECT id, ((id + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((id + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE)) * total AS x FROM (SELECT unnest(range(total::BIGINT)) AS id, total FROM (SELECT max(hi) AS total FROM r))),
k AS (SELECT place, blocks, row_number() OVER (PARTITION BY place ORDER BY id) - 1 AS rank FROM x JOIN r ON x >= lo AND x < hi),
p AS (SELECT place, rank % blocks AS block, count(*) AS plays FROM k WHERE rank < 3 * blocks GROUP BY ALL),
o AS (SELECT doc_id, size, r.source_size, target, place, len, sum(size) OVER (PARTITION BY place ORDER BY md5('7:' || doc_id), doc_id::VARCHAR, size) - size AS at FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, unnest(range((o.at // len)::BIGINT, ((o.at + size - 1) // len)::BIGINT + 1)) AS block FROM o WHERE size > 0),
z AS (SELECT doc_id, sum((least(q.at + size, (q.block + 1) * len) - greatest(q.at, q.block * len)) * coalesce(plays, 0)) AS taken FROM q LEFT JOIN p ON p.place = q.place AND p.block = q.block GROUP BY doc_id)
SELECT o.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM o LEFT JOIN z USING (doc_id)
"""
