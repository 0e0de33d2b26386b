"""Vector expressions over array columns: folds in double precision, left to right, inside the JVM; and the same cosine over Arrow tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """dot / sqrt(|a|^2 * |b|^2); 0 where a norm is zero; null where the lengths differ."""
    scale = dot(a, a) * dot(b, b)
    return F.when(F.size(a) == F.size(b), F.when(scale > 0, dot(a, b) / F.sqrt(scale)).otherwise(F.lit(0.0)))


def normalized(a: Column) -> Column:
    """The vector at unit length; a zero vector as it is."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


#: How far a matrix product may be from the fold; sources compared at a time.
_SLACK, _SLAB = 1e-9, 256


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vector length -> (rows, their vectors as doubles). Rows with a null element are left out: no cosine of theirs is known."""
    lists = pa.concat_arrays(table["embedding"].chunks) if table["embedding"].num_chunks else pa.array([], table.schema.field("embedding").type)
    n, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
    known, first = np.ones(len(n), bool), np.cumsum(n) - n
    known[np.repeat(np.arange(len(n)), n)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return {int(k): (rows := np.flatnonzero((n == k) & known), values[first[rows][:, None] + np.arange(k)]) for k in np.unique(n[known])}


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``dot`` of the columns of two matrices, added up in its order."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def _cosine(dots: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.divide(dots, np.sqrt(scale), out=np.zeros_like(dots), where=~(scale <= 0))


def most_similar(threshold: float, most: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Of two tables (id, embedding), each left row's ``most`` right rows of greatest ``cosine`` at or over the threshold, other ids
    alone, ties by id descending: (source, target, weight). A matrix product finds them, the fold weighs and ranks them."""

    def found(s: np.ndarray, t: np.ndarray, own: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        across, back = np.ascontiguousarray(s.T), np.ascontiguousarray(t.T)
        aa, bb = _fold(across, across), _fold(back, back)
        for a in range(0, len(s), _SLAB):
            near = _cosine(s[a : a + _SLAB] @ back, aa[a : a + _SLAB, None] * bb)
            near[np.isnan(near)] = np.inf
            near[own[a : a + _SLAB, None] == other] = -np.inf
            least = np.full(len(near), threshold)
            if len(t) > most:
                least = np.maximum(least, np.partition(near, len(t) - most, axis=1)[:, len(t) - most])
            i, j = np.nonzero(near >= least[:, None] - _SLACK)
            weight = _cosine(_fold(across[:, a + i], back[:, j]), aa[a + i] * bb[j])
            kept = ~(weight < threshold)
            i, j, weight = i[kept], j[kept], weight[kept]
            order = np.lexsort((-other[j], -np.where(np.isnan(weight), np.inf, weight), i))
            i, j, weight = i[order], j[order], weight[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < most
            yield a + i[top], j[top], weight[top]

    def compare(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = pa.concat_arrays([*left["id"].chunks, *right["id"].chunks])
        unlike = ids.unique()
        place = np.empty(len(unlike), np.int64)
        place[pc.sort_indices(unlike).to_numpy()] = np.arange(len(unlike))
        place = place[pc.index_in(ids, unlike).to_numpy()]
        own, other = place[: len(left)], place[len(left) :]
        sources, targets = _by_length(left), _by_length(right)
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        with np.errstate(all="ignore"):
            for n in sources.keys() & targets.keys():
                (at, s), (to, t) = sources[n], targets[n]
                got += [(at[i], to[j], weight) for i, j, weight in found(s, t, own[at], other[to])]
        i, j, weight = map(np.concatenate, zip(*got, strict=True))
        return pa.table({"source": left["id"].take(pa.array(i)), "target": right["id"].take(pa.array(j)), "weight": weight})

    return compare
