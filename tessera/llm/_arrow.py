"""Row-wise annotation of text columns in Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_TEXT = "__text__"
_PIECE_BYTES = 8 << 20


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system: a worker is used again by later stages, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batch: pa.RecordBatch, column: str | int, most: int = _PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text each; a row is never cut."""
    import numpy as np

    from tessera.llm._words import string_buffers

    _, off = string_buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def annotate(df: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], list]], fields: list[T.StructField], keep: Iterable[str], piece_bytes: int = _PIECE_BYTES) -> DataFrame:
    """``keep`` columns of ``df`` and, beside them, what the function made by ``make`` returns for the text column.

    ``make`` runs once per task; its function gets a string array and returns one array or list per field. An input column
    named like a result is replaced by it. Rows are neither added nor dropped.
    """
    made = {f.name for f in fields}
    keep = [c for c in keep if c not in made]
    source = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"].cast("string").alias(_TEXT))
    schema = T.StructType([*(source.schema[c] for c in keep), *fields])
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for piece in pieces(batch, _TEXT, piece_bytes):
                out = function(piece.column(_TEXT))
                own = [x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *own], names=[*keep, *(f.name for f in fields)])
                del out, own
                give_back()

    return source.mapInArrow(run, schema)


def select_rows(df: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], list]], piece_bytes: int = _PIECE_BYTES) -> DataFrame:
    """The rows of ``df``, all columns, for which the function made by ``make`` says true of the text column.

    A null text reaches the function as null; repeated rows are each judged; an empty table stays empty.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for piece in pieces(batch, at, piece_bytes):
                yield piece.filter(pa.array(function(piece.column(at)), pa.bool_()))
                give_back()

    return df.mapInArrow(run, df.schema)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T.DataType.fromDDL(kind), True)
