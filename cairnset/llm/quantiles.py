"""Percentiles of very large numeric columns from mergeable q-digests.

Values are quantised to a bounded ordered universe (the leading 31 bits of the non-negative double, so the relative
width of a cell is 2**-20 and integers below 2**21 are exact), counted in a dyadic tree and compressed bottom-up: a node
and its sibling move into their parent while the three counts together stay at or under floor(n / k). Digests are merged
by adding the counts of equal nodes and compressing again. With k = ceil(31 / eps) the rank error is at most eps * n, for
one digest and after any number of merges; each answer also carries the bound that holds for it.

Every task digests its own rows (a group of any size is only ever a few thousand nodes by the time it is shuffled), then
digests are merged in two steps, salted and whole, so no task sees more than the square root of all digests of a group.

Null, NaN and negative values are left out; a group without usable values has no row; null group names form a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnset.session import squeeze

LEVELS = 31
_LOW = np.uint64(0xFFFFFFFF)
_SHIFT = np.uint64(32)
_PACKED = [T.StructField("measure", T.StringType()), T.StructField("n", T.LongType()), T.StructField("nodes", T.BinaryType()),
           T.StructField("counts", T.BinaryType())]


def encode(values: np.ndarray) -> np.ndarray:
    """Tree node of each non-negative double: leaves are numbered from 2**31, a parent is half its child."""
    return (np.abs(values.astype(np.float64)).view(np.uint64) >> _SHIFT) | np.uint64(1 << LEVELS)


def decode(nodes: np.ndarray) -> np.ndarray:
    """Lower edge of the last cell under each node."""
    level = np.frexp(nodes.astype(np.float64))[1].astype(np.uint64) - np.uint64(1)
    last = ((nodes + np.uint64(1)) << (np.uint64(LEVELS) - level)) - np.uint64(1)
    return ((last & np.uint64(0x7FFFFFFF)) << _SHIFT).view(np.float64)


def _add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def compress(keys: np.ndarray, counts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compress many digests at once; a key is digest << 32 | node, limits[digest] = floor(n / k)."""
    keys, counts = _add(keys, counts)
    if not len(keys) or not limits.any():
        return keys, counts
    level = np.frexp((keys & _LOW).astype(np.float64))[1] - 1
    kept_k, kept_c = [], []
    cur_k, cur_c = keys[level == LEVELS], counts[level == LEVELS]
    for at in range(LEVELS, 0, -1):
        up_k, up_c = keys[level == at - 1], counts[level == at - 1]
        if len(cur_k):
            parent = (cur_k & ~_LOW) | ((cur_k & _LOW) >> np.uint64(1))
            first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            pair, total = parent[first], np.add.reduceat(cur_c, first)
            if len(up_k):
                spot = np.minimum(np.searchsorted(up_k, pair), len(up_k) - 1)
                above = np.where(up_k[spot] == pair, up_c[spot], 0)
            else:
                above = 0
            merged = total + above <= limits[(pair >> _SHIFT).astype(np.int64)]
            stays = ~np.repeat(merged, np.diff(np.r_[first, len(cur_k)]))
            kept_k.append(cur_k[stays])
            kept_c.append(cur_c[stays])
            up_k, up_c = _add(np.r_[up_k, pair[merged]], np.r_[up_c, total[merged]])
        cur_k, cur_c = up_k, up_c
    return _add(np.concatenate([*kept_k, cur_k]), np.concatenate([*kept_c, cur_c]))


def quantiles(nodes: np.ndarray, counts: np.ndarray, at: list[float]) -> list[tuple[float, int]]:
    """(value, largest possible rank error) of each quantile of one digest."""
    level = np.frexp(nodes.astype(np.float64))[1].astype(np.uint64) - np.uint64(1)
    span = np.uint64(LEVELS) - level
    low, high = nodes << span, ((nodes + np.uint64(1)) << span) - np.uint64(1)
    order = np.lexsort((span, high))
    nodes, counts, low, high = nodes[order], counts[order], low[order], high[order]
    cum, n = np.cumsum(counts), int(counts.sum())
    out = []
    for q in at:
        i = int(np.searchsorted(cum, max(1, int(np.ceil(q * n)))))
        i = min(i, len(nodes) - 1)
        unsure = int(counts[(low <= high[i]) & (high > high[i])].sum())
        inner = int(counts[i]) if low[i] != high[i] else 0
        out.append((float(decode(nodes[i:i + 1])[0]), unsure + inner))
    return out


def _k(eps: float) -> int:
    return int(np.ceil(LEVELS / eps))


class _Digests:
    """Digests of many groups in one task: values and nodes are added, everything is compressed together."""

    def __init__(self, by: list[str], k: int, hold: int = 2_000_000):
        self.by, self.k, self.hold = by, k, hold
        self.ids: dict[tuple, int] = {}
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def groups(self, batch: pa.RecordBatch, measure: str | None = None) -> np.ndarray:
        """Number of the group of each row; a given measure is the last part of the key."""
        code, values = np.zeros(batch.num_rows, np.int64), []
        for c in self.by if measure else [*self.by, "measure"]:
            d = batch.column(batch.schema.get_field_index(c)).dictionary_encode()
            values.append([*d.dictionary.to_pylist(), None])
            code = code * len(values[-1]) + d.indices.fill_null(len(values[-1]) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        seen, inverse = np.unique(code, return_inverse=True)
        numbers = np.empty(len(seen), np.int64)
        for j, s in enumerate(seen.tolist()):
            key = [measure] if measure else []
            for v in reversed(values):
                s, r = divmod(s, len(v))
                key.append(v[r])
            numbers[j] = self.ids.setdefault(tuple(reversed(key)), len(self.ids))
        return numbers[inverse]

    def add(self, group: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> None:
        self.fresh.append(((group.astype(np.uint64) << _SHIFT) | nodes, counts))
        self.held += len(nodes)
        if self.held > self.hold:
            self.fold()

    def fold(self) -> None:
        keys, counts = _add(np.concatenate([self.keys, *[f[0] for f in self.fresh]]), np.concatenate([self.counts, *[f[1] for f in self.fresh]]))
        sizes = np.bincount((keys >> _SHIFT).astype(np.int64), weights=counts, minlength=len(self.ids))
        self.keys, self.counts = compress(keys, counts, (sizes / self.k).astype(np.int64))
        self.fresh, self.held = [], 0

    def rows(self, target: pa.Schema) -> Iterator[pa.RecordBatch]:
        self.fold()
        owner, names = (self.keys >> _SHIFT).astype(np.int64), list(self.ids)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        nodes, counts, rows = (self.keys & _LOW).astype("<u4"), self.counts.astype("<i8"), []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(owner)]):
            rows.append((*names[owner[a]], int(counts[a:b].sum()), nodes[a:b].tobytes(), counts[a:b].tobytes()))
        for a in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[a:a + 5000]), target)], schema=target)


def _schemas(df: DataFrame, by: list[str]) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [(c, to_arrow_type(df.schema[c].dataType)) for c in by]
    return (T.StructType([df.schema[c] for c in by] + _PACKED),
            pa.schema([*fields, ("measure", pa.string()), ("n", pa.int64()), ("nodes", pa.binary()), ("counts", pa.binary())]))


def digest_groups(df: DataFrame, by: list[str], measures: list[str], eps: float) -> DataFrame:
    """One digest row per task, group and measure: by..., measure, n, nodes, counts (packed little-endian arrays)."""
    k = _k(eps)
    schema, target = _schemas(df, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Digests(by, k)
        for b in batches:
            for m in measures if b.num_rows else ():
                v = b.column(b.schema.get_field_index(m)).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                ok = np.flatnonzero(v >= 0)
                held.add(held.groups(b, m)[ok], encode(v[ok]), np.ones(len(ok), np.int64))
        yield from held.rows(target)

    return df.select(*by, *measures).mapInArrow(run, schema)


def merge_digests(digests: DataFrame, by: list[str], eps: float, salts: int | None = None) -> DataFrame:
    """Add up all digests of a group (by node), from whatever tasks, partitions or days they come.

    In two steps, unless salts is 1: the digests of a group are first dealt over `salts` tasks.
    """
    k = _k(eps)
    schema, target = _schemas(digests, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Digests(by, k)
        for b in batches:
            if b.num_rows:
                group = held.groups(b)
                nodes = [np.frombuffer(x, "<u4") for x in b.column(b.schema.get_field_index("nodes")).to_pylist()]
                counts = [np.frombuffer(x, "<i8") for x in b.column(b.schema.get_field_index("counts")).to_pylist()]
                held.add(np.repeat(group, [len(x) for x in nodes]), np.concatenate(nodes).astype(np.uint64), np.concatenate(counts))
        yield from held.rows(target)

    salts = salts or max(1, int(np.sqrt(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    slim = digests.select(*by, "measure", "n", "nodes", "counts")
    if salts > 1:
        salt = F.pmod(F.xxhash64("nodes"), F.lit(salts))
        slim = slim.withColumn("salt", salt).repartition(*by, "measure", "salt").mapInArrow(run, schema)
    return slim.repartition(*by, "measure").mapInArrow(run, schema)


def read_quantiles(digests: DataFrame, by: list[str], at: list[float]) -> DataFrame:
    """by..., measure, n, percentile, estimate, max_rank_error: one row per digest and quantile."""
    schema = T.StructType([digests.schema[c] for c in [*by, "measure", "n"]] + [
        T.StructField("percentile", T.DoubleType()), T.StructField("estimate", T.DoubleType()), T.StructField("max_rank_error", T.LongType())])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                nodes, counts = np.frombuffer(r.nodes, "<u4").astype(np.uint64), np.frombuffer(r.counts, "<i8")
                keys = tuple(getattr(r, c) for c in [*by, "measure"])
                rows += [(*keys, r.n, 100 * q, v, e) for q, (v, e) in zip(at, quantiles(nodes, counts, at))]
            yield pd.DataFrame(rows, columns=schema.names)

    return digests.select(*by, "measure", "n", "nodes", "counts").mapInPandas(read, schema)


def once_per_run(runs: DataFrame) -> DataFrame:
    """Each run_id once (repeats are identical; of differing rows the smallest is taken), names cleaned.

    Rows without a run_id cannot be recognised as repeats and are kept as they are.
    """
    row = F.struct("received_on", "condition", "model", "wall_seconds", "input_tokens").alias("row")
    known = runs.where("run_id is not null").select("run_id", row).groupBy("run_id").agg(F.min("row").alias("row")).select("row")
    one = known.union(runs.where("run_id is null").select(row))
    return one.select(
        F.col("row.received_on").alias("received_on"), squeeze(F.col("row.condition")).alias("condition"),
        squeeze(F.col("row.model")).alias("model"), F.col("row.wall_seconds").alias("wall_seconds"),
        F.col("row.input_tokens").alias("input_tokens"))
