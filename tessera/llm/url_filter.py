"""URL rules behind a blocked Bloom filter and an exact join.

Listed entries are canonical keys ``host + path prefix``. Every key that a URL could match (each host suffix with each
listed prefix length of its path) is tested against the filter; only the possible hits go on to a hash join with the list,
which removes the filter's false positives. The filter's size is a parameter, so its broadcast never grows with the list.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import annotate, field
from tessera.llm._storage import materialize
from tessera.llm._words import mix64

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())
MOST_BROADCAST_KEYS = 1 << 16
_MULTIPLIERS = mix64(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def _key_hashes(keys: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


class BlockedBloom:
    """Blocks of eight 64-bit words (one cache line); a key sets one bit in each word of one block."""

    def __init__(self, words: np.ndarray):
        self.words = words.reshape(-1, 8)

    @staticmethod
    def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        bits = (hashes[:, None] * _MULTIPLIERS[None, :]) >> np.uint64(58)
        return block.astype(np.int64), np.uint64(1) << bits

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each 64-bit hash may have been added."""
        out = np.empty(len(hashes), bool)
        for k in range(0, len(hashes), 1 << 16):
            block, masks = self.places(hashes[k : k + (1 << 16)], len(self.words))
            out[k : k + (1 << 16)] = ((self.words[block] & masks) == masks).all(1)
        return out

    def may_contain(self, keys: list[str]) -> np.ndarray:
        return self.contains(_key_hashes(keys))


def build_bloom(keys: DataFrame, column: str, blocks: int) -> BlockedBloom:
    """The filter of a column of string keys or of 64-bit hashes, built where they are; at most ``blocks`` * 8 words reach the driver."""
    hashed = dict(keys.dtypes)[column] == "bigint"

    def run(batches):
        for batch in batches:
            own = batch.column(0)
            block, masks = BlockedBloom.places(own.to_numpy().view(np.uint64) if hashed else _key_hashes(own.to_pylist()), blocks)
            at = (block[:, None] * 8 + np.arange(8)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(masks.ravel().view(np.int64))], names=["at", "mask"])

    words = keys.select(column).dropna().mapInArrow(run, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(blocks * 8, np.int64)
    for r in words.toLocalIterator():
        out[r["at"]] = r["mask"]
    return BlockedBloom(out.view(np.uint64))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): both empty without ``://``."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in (tail.find(c) for c in "?#") if k >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


def suffixes(host: str) -> list[str]:
    parts = host.split(".")
    return [".".join(parts[k:]) for k in range(len(parts))]


def _candidates(bloom: BlockedBloom, lengths: list[int]) -> Callable[[], Callable[[pa.Array], list]]:
    def make():
        def run(urls: pa.Array) -> list:
            split = [split_url(u) for u in urls.to_pylist()]
            keys, owner = [], []
            for k, (host, path) in enumerate(split):
                if host:
                    own = [s + path[:n] for s in suffixes(host) for n in lengths if n <= len(path)]
                    keys += own
                    owner += [k] * len(own)
            hits: list[list[str]] = [[] for _ in split]
            if keys:
                for at in np.flatnonzero(bloom.may_contain(keys)).tolist():
                    hits[owner[at]].append(keys[at])
            return [[h for h, _ in split], [p for _, p in split], hits]

        return run

    return make


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", blocks: int = 1 << 14) -> DataFrame:
    """``keep`` columns, host, path, rule (longest that fits, else null) and verdict (the rule's, else ``default``) per row.

    ``rules`` has host, path and verdict ('allow' or 'block'); a rule fits its host and the subdomains of it if the URL's
    path starts with the rule's. Of rules with one key, 'block' wins. Null or malformed URLs have an empty host and path,
    fit nothing and get the default. Rows are neither merged nor dropped; an empty rule table leaves the default everywhere.
    ``blocks`` fixes the filter at 64 bytes each, whatever the list's size; a fuller filter only passes more keys to the join.
    """
    listed = rules.select(F.concat(F.translate("host", _UPPER, _UPPER.lower()), F.col("path")).alias("__key__"), F.length("path").alias("__len__"), "verdict").where("__key__ is not null")
    listed = listed.groupBy("__key__").agg(F.max(F.struct(F.col("verdict") == "block", F.col("verdict")))["verdict"].alias("__verdict__"), F.max("__len__").alias("__len__"))
    listed = listed.where(F.col("__key__").contains("/") | (F.col("__len__") == 0))
    lengths = sorted(r[0] for r in listed.select("__len__").distinct().collect())
    bloom = build_bloom(listed, "__key__", blocks)
    keep = tuple(c for c in keep if c not in ("host", "path", "rule", "verdict"))
    found = annotate(pages, url, _candidates(bloom, lengths), [field("host", "string"), field("path", "string"), field("__hits__", "array<string>")], keep)
    numbered = materialize(found.withColumn("__row__", F.monotonically_increasing_id()), "urls")
    possible = numbered.where(F.size("__hits__") > 0).select("__row__", F.explode("__hits__").alias("__key__"))
    # the exact join, on each possible key once
    real = listed.select("__key__", "__verdict__").join(possible.select("__key__").distinct(), "__key__", "left_semi")
    small = real.limit(MOST_BROADCAST_KEYS + 1).count() <= MOST_BROADCAST_KEYS
    best = possible.join(F.broadcast(real) if small else real, "__key__").groupBy("__row__").agg(F.max(F.struct(F.length("__key__").alias("n"), F.col("__key__"), F.col("__verdict__"))).alias("__best__"))
    out = lambda df, rule, verdict: df.select(*[F.col(f"`{c}`") for c in keep], "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    hit = numbered.where(F.size("__hits__") > 0).join(best, "__row__", "left")
    judged = out(hit, F.col("__best__.__key__"), F.coalesce("__best__.__verdict__", F.lit(default)))
    return judged.unionByName(out(numbered.where(F.size("__hits__") == 0), F.lit(None).cast("string"), F.lit(default)))


#: The rules of the query (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP10_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS cut FROM pages),
s AS (SELECT page_id, CASE WHEN cut > 0 THEN substr(url, cut + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM s),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT p.*, (SELECT arg_max({'rule': rhost || rpath, 'verdict': rverdict}, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m
"""
