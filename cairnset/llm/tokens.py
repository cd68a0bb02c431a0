"""Vectorised word tokens over code points, and token counts with a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GAP, WORD, MARK = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
DEFAULT_TOKENIZER = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.full(0x10000, MARK, np.uint8), np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isspace() or unicodedata.category(c) in ("Cc", "Cf", "Zs"):
            kind[i] = GAP
        elif (c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M") and not 0x3040 <= i < 0xA000:
            kind[i] = WORD
        low = c.lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return kind, lower


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, b & _MASK, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span, in one pass over the values."""
    up, down = _power(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start])


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def words(cp: np.ndarray, marks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the lower-cased words; marks: also each punctuation character or ideograph."""
    kinds, lower = _tables()
    low16 = np.minimum(cp, 0xFFFF)
    kind = kinds[low16]
    value = np.where(cp < 0x10000, lower[low16], cp) + np.uint32(1)
    word = kind == WORD
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if marks:
        single = np.flatnonzero(kind == MARK)
        start, end = np.r_[start, single], np.r_[end, single + 1]
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    return start, end, span_hashes(value, start, end)


@functools.cache
def encoder(path: str):
    """The byte-level tokenizer of a rank file; its path is a parameter of every operator that counts tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, tokenizer: str = DEFAULT_TOKENIZER) -> Column:
    """Number of tokens of a text (0 for null and empty), in Arrow batches; special tokens are ordinary text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(tokenizer).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
