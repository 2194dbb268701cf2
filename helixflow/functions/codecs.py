"""Codecs that built-in expressions can't express: two bits a base, most significant first, four bases a byte."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

_CODE = np.full(256, 255, np.uint8)
_CODE[list(b"ACGT")] = range(4)
_BASE = np.frombuffer(b"ACGT", np.uint8)


def pack_one(seq: str) -> bytes:
    codes = _CODE[np.frombuffer(seq.encode(), np.uint8)]
    if (codes > 3).any():
        raise ValueError("only A, C, G and T can be packed")
    codes = np.pad(codes, (0, -len(codes) % 4)).reshape(-1, 4)
    return (codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]).astype(np.uint8).tobytes()


def unpack_one(data: bytes, n: int) -> str:
    if len(data) != -(-n // 4):
        raise ValueError("the number of bases doesn't fit the bytes")
    b = np.frombuffer(data, np.uint8)
    return _BASE[np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3], axis=1).reshape(-1)[:n]].tobytes().decode()


@pandas_udf(BinaryType())
def pack_dna(seq: pd.Series) -> pd.Series:
    return seq.map(lambda s: None if s is None else pack_one(s))


@pandas_udf(StringType())
def unpack_dna(data: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or pd.isna(k) else unpack_one(d, int(k)) for d, k in zip(data, n, strict=True)])
