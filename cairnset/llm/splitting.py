"""Splitting oversized items at natural boundaries by lexical cohesion.

An item longer than `max_size` characters (code points) is cut into pieces of at most that size; each piece starts
exactly `overlap` characters before the end of the one before, so the item is the first piece followed by the others
without their first `overlap` characters. Candidate cuts are line and sentence ends. At each, the words of the block
before and of the block after are compared (cosine of counts; of hashed counts beyond 1,024 different words); a topic boundary is a valley of that similarity,
and in every size window the deepest valley is chosen: line ends first, then sentence ends, then the last blank, then
the last place that does not part a base character from its marks.

Null, empty and short items are not split. Equal valleys: the later one. A text of any length is worked off in slabs,
so memory does not grow with it.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnset.llm import tokens as K

_DIM, _BLOCK, _SLAB = 1024, 600, 1 << 18
_STOPS = np.array([ord(c) for c in ".!?;"], np.uint32)
_WIDE_STOPS = np.array([0x3002, 0xFF01, 0xFF1F], np.uint32)
PIECES = "array<struct<start:int,size:int,piece:string>>"


class _Slab:
    """Boundaries of one stretch of text and the similarity of the blocks on both sides of each."""

    def __init__(self, cp: np.ndarray, base: int):
        self.base, self.end = base, base + len(cp)
        prev = cp[:-1]
        line = (prev == 10) | ((prev == 13) & (cp[1:] != 10))
        sentence = np.isin(prev, _WIDE_STOPS)
        blank = (prev == 32) | (prev == 9) | (prev == 0x3000)
        sentence[1:] |= blank[1:] & np.isin(prev[:-1], _STOPS)
        at = np.flatnonzero(line | sentence) + 1
        start, _, h = K.words(cp, marks=False)
        bounds = np.r_[0, at]
        unit = np.searchsorted(bounds, start, "right") - 1
        distinct, word = np.unique(h, return_inverse=True)
        dim = max(1, len(distinct))
        if dim > _DIM:  # so many different words are counted by hash
            word, dim = (h & np.uint64(_DIM - 1)).astype(np.int64), _DIM
        hist = np.bincount(unit * dim + word, minlength=len(bounds) * dim)
        cum = np.zeros((len(bounds) + 1, dim), np.float32)
        np.cumsum(hist.reshape(-1, dim), axis=0, out=cum[1:])
        here = np.arange(1, len(bounds))
        before = np.minimum(np.searchsorted(bounds, at - _BLOCK), here - 1)
        after = np.maximum(np.searchsorted(bounds, at + _BLOCK, "right") - 1, here + 1)
        left, right = cum[here] - cum[before], cum[np.minimum(after, len(bounds))] - cum[here]
        norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
        self.similarity = (left * right).sum(1) / np.maximum(norm, 1e-9)
        s = np.r_[np.inf, self.similarity, np.inf]
        self.valley = (s[1:-1] <= s[:-2]) & (s[1:-1] <= s[2:])
        self.at, self.is_line = at + base, line[at - 1]
        self.blanks = np.flatnonzero(blank) + 1 + base

    def cut(self, low: int, high: int) -> int | None:
        """The deepest valley in [low, high], by line ends, else sentence ends, else the last blank."""
        a, b = np.searchsorted(self.at, low), np.searchsorted(self.at, high, "right")
        if b > a:
            fit = self.is_line[a:b] if self.is_line[a:b].any() else np.ones(b - a, bool)
            fit = fit & self.valley[a:b] if (fit & self.valley[a:b]).any() else fit
            c, d = np.searchsorted(self.at, low - _BLOCK), np.searchsorted(self.at, high + _BLOCK, "right")
            s = self.similarity[c:d]  # the peaks beside a valley may lie outside the window
            depth = (np.maximum.accumulate(s) + np.maximum.accumulate(s[::-1])[::-1] - 2 * s)[a - c:b - c]
            pick = np.flatnonzero(fit)
            return int(self.at[a + pick[len(pick) - 1 - int(np.argmax(depth[pick][::-1]))]])
        i = np.searchsorted(self.blanks, high, "right")
        return int(self.blanks[i - 1]) if i and self.blanks[i - 1] >= low else None


def _whole(cp: np.ndarray, low: int, high: int) -> int:
    """The last cut up to `high` that parts no base from its marks, no joined sequence and no CR from its LF."""
    for e in range(high, low, -1):
        nxt, last = chr(cp[e]), chr(cp[e - 1])
        if not (unicodedata.category(nxt)[0] == "M" or nxt == "‍" or last == "‍" or 0x1F3FB <= cp[e] <= 0x1F3FF or (last == "\r" and nxt == "\n")):
            return e
    return high


def spans(text: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of each piece; one span for a text that fits."""
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be at least 0 and less than max_size")
    n = len(text)
    if n <= max_size:
        return [(0, n)]
    cp = K.codepoints(text)
    out, start, slab = [], 0, None
    while start + max_size < n:
        low, high = start + max(overlap + 1, max_size // 2), start + max_size
        if slab is None or (high + _BLOCK > slab.end and slab.end < n):
            base = max(0, start - _BLOCK)
            slab = _Slab(cp[base:base + max(_SLAB, 4 * max_size)], base)
        end = slab.cut(low, high) or slab.cut(start + overlap + 1, low) or _whole(cp, start + overlap + 1, high)
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def pieces(content: Column, max_size: int, overlap: int) -> Column:
    """The pieces of a text as an array of (start, size, piece)."""

    @F.pandas_udf(PIECES)
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else [{"start": a, "size": b - a, "piece": t[a:b]} for a, b in spans(t, max_size, overlap)]
            for t in texts])

    return split(content)


def split_oversized(chunks: DataFrame, max_size: int, overlap: int) -> DataFrame:
    """chunk_id, file_id, piece_no, n_pieces, start, size, piece of each item beyond max_size, each chunk once.

    Rows sent again count once by chunk_id; rows without a chunk_id count once by their content.
    """
    over = chunks.where(F.char_length("content") > max_size)
    key = F.coalesce("chunk_id", F.concat(F.lit("-"), F.md5(F.concat_ws("|", "file_id", "seq", "content"))))
    once = over.groupBy(key.alias("chunk_key")).agg(F.min(F.struct("chunk_id", "file_id", "content")).alias("c"))
    cut = once.select("c.chunk_id", "c.file_id", pieces(F.col("c.content"), max_size, overlap).alias("pieces"))
    return cut.select("chunk_id", "file_id", F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece_no", "p")).select(
        "chunk_id", "file_id", "piece_no", "n_pieces", F.col("p.start").alias("start"), F.col("p.size").alias("size"), F.col("p.piece").alias("piece"))


def current_files(files: DataFrame) -> DataFrame:
    """One row per file_id: the state that is not stale, then the latest; the path with forward slashes and no `./`."""
    path = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(\./)+|(?<=/)(\./)+", "")
    rank = F.struct((~F.coalesce("stale", F.lit(True))).alias("fresh"), F.coalesce("mtime", F.lit(0)).alias("mtime"), F.coalesce("indexed_at", F.lit(0)).alias("at"), F.coalesce(path, F.lit("")).alias("path"))
    return files.where("file_id is not null").groupBy("file_id").agg(
        F.max_by(path, rank).alias("path"), F.max_by("project", rank).alias("project"), F.max_by("language", rank).alias("language"))
