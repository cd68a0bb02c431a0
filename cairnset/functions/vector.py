"""Vectors as bytes: little-endian 32-bit floats, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_floats(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")

    return encode(vector)


def decode_floats(raw: Column) -> Column:
    """Null for null; bytes that are no whole number of floats are an error."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, "<f4"), na_action="ignore")

    return decode(raw)
