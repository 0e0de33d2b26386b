"""Vectors as little-endian float32 bytes, the form that other stores keep them in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vector_bytes(dim: int):
    """A UDF from vectors to bytes; a vector of another length fails."""

    @F.pandas_udf(T.BinaryType())
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else _checked(np.asarray(v, "<f4"), dim).tobytes())

    return run


def bytes_vector(dim: int):
    """A UDF from bytes to vectors; bytes of another length fail."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else _checked(np.frombuffer(b, "<f4"), dim).tolist())

    return run


def _checked(vector: np.ndarray, dim: int) -> np.ndarray:
    if len(vector) != dim:
        raise ValueError(f"a vector of {len(vector)} numbers, {dim} expected")
    return vector


def probe_dim(embedder) -> int:
    """The length of an embedder's vectors, found by embedding one short text; another ``dim`` than it states fails."""
    found = len(embedder.embed("probe"))
    stated = getattr(embedder, "dim", found)
    if stated != found:
        raise ValueError(f"the embedder states {stated} numbers and gives {found}")
    return found
