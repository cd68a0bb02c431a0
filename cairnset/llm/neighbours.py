"""The k most similar vectors of every vector: lists, score-aware 4-bit codes, table scans, exact reranking.

An index is fitted on a bounded sample (64 vectors a list and 8,192 at least, `FIT_ROWS` at most, chosen by a hash of the id; this bound is a
documented parameter): spherical k-means centroids, about one per `LIST_ROWS` vectors, and 16 code words for each group of
four dimensions of the residuals. Code words are trained and assigned with the anisotropic loss, which weighs the residual
error parallel to the vector `ETA` times the error across it, because only the parallel part shifts large inner products.
Every row is then indexed: it is coded into its nearest list and searches the `PROBES` nearest lists. A search adds up table
entries for the 4-bit codes of a list, takes the `RERANK` best and ranks those by their cosine.

Neighbouring lists form groups of about `GROUP_LISTS`, and a group is one task: a vector travels once to the group of its
own list, where it is both data and query, and once to every other group that holds one of its lists, not once to each list.
Directions travel as 16-bit fixed-point numbers, so cosines are right to about 1e-5. A sample of bounded size gives at most
`MAX_LISTS` lists; in a table so large that lists outgrow `LIST_ROWS`, a task divides its lists again by centroids of its own and
a query scans only the nearest parts, so the rows scanned per query do not grow with the table. A group of more than
`block` rows is split in parts, and its queries in turns, each a task of its own.

Of vectors with one direction the k + 1 with the smallest ids are indexed; any further copy has the first k of them as its
neighbours (their cosine is 1 and no others come before them), so a vector that makes up a third of the table fills no list.

Only finite vectors of the given length that are not all zero take part, each id once; null ids do not. Equal cosines are
ordered by id. Fewer than k others: as many as there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnset.session import cut, salted_join

FIT_ROWS, LIST_ROWS, MAX_LISTS, GROUP_LISTS, PROBES, RERANK, BLOCK, ETA, SUB = 65_536, 512, 2_048, 8, 8, 128, 32_768, 2.6, 4
#: Rows of the table of much repeated vectors that may be broadcast; a larger one is joined by a salted shuffle.
BROADCAST_ROWS = 20_000


@dataclass
class Index:
    centroids: np.ndarray  # lists x dim
    group_of: np.ndarray  # the group of each list
    words: np.ndarray  # groups x 16 x SUB


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _nearest(x: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The k best centroids of each row, best first."""
    out = []
    for a in range(0, len(x), 1024):
        s = x[a:a + 1024] @ centroids.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def assign(x: np.ndarray, residual: np.ndarray, words: np.ndarray, eta: float = ETA, sweeps: int = 2) -> np.ndarray:
    """Codes by coordinate descent on |r|^2 + (eta - 1) <r, x>^2, r being what the code leaves over."""
    groups = len(words)
    xs, rs = x.reshape(len(x), groups, SUB), residual.reshape(len(x), groups, SUB)
    error = np.stack([((rs[:, m, None] - words[m]) ** 2).sum(2) for m in range(groups)], 1)
    along = np.stack([((rs[:, m, None] - words[m]) * xs[:, m, None]).sum(2) for m in range(groups)], 1)
    code = error.argmin(2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for m in range(groups):
            rest = total - along[rows, m, code[:, m]]
            code[:, m] = (error[:, m] + (eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            total = rest + along[rows, m, code[:, m]]
    return code.astype(np.uint8)


def _means(x: np.ndarray, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Spherical k-means from the given centroids; an empty one stays where it is."""
    for _ in range(rounds):
        at = _nearest(x, centroids, 1)[:, 0]
        order = np.argsort(at, kind="stable")
        present, first = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = centroids.copy()
        centroids[present] = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids[present])
    return centroids


def fit(sample: np.ndarray, lists: int, seed: int = 5, rounds: int = 8, group_lists: int = GROUP_LISTS) -> Index:
    """Centroids, their groups and code words from a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    centroids = _means(sample, sample[rng.choice(len(sample), lists, replace=False)].copy(), rounds)
    n_groups = max(1, round(lists / group_lists))
    heads = _means(centroids, centroids[rng.choice(lists, n_groups, replace=False)].copy(), rounds)
    group_of = _nearest(centroids, heads, 1)[:, 0].astype(np.int32)
    some = sample[rng.permutation(len(sample))[:8_192]]
    residual = some - centroids[_nearest(some, centroids, 1)[:, 0]]
    groups = sample.shape[1] // SUB
    rs, xs = residual.reshape(len(some), groups, SUB), some.reshape(len(some), groups, SUB)
    words = np.stack([rs[rng.choice(len(some), 16, replace=len(some) < 16), m] for m in range(groups)])
    for turn in range(rounds):
        eta = 1.0 if turn < rounds // 2 else ETA
        code = assign(some, residual, words, eta, 1)
        left = rs - np.take_along_axis(words[None], code[:, :, None, None].astype(np.int64), 2)[:, :, 0]
        along = (left * xs).sum(2)
        rest = along.sum(1, keepdims=True) - along
        for m in range(groups):
            for c in range(16):
                i = np.flatnonzero(code[:, m] == c)
                if len(i):  # the least squares of the anisotropic loss for this code word
                    x, r = xs[i, m].astype(np.float64), rs[i, m].astype(np.float64)
                    a = len(i) * np.eye(SUB) + (eta - 1) * x.T @ x
                    b = r.sum(0) + (eta - 1) * (x * ((x * r).sum(1) + rest[i, m])[:, None]).sum(0)
                    words[m, c] = np.linalg.solve(a, b)
    return Index(centroids, group_of, words.astype(np.float32))


def pack_codes(code: np.ndarray) -> np.ndarray:
    return (code[:, ::2] << 4) | code[:, 1::2]


def tables(queries: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each byte of two codes the 256 sums that byte may add, query by query (bytes x 256 x queries)."""
    groups, dim = len(words), queries.shape[1]
    part = np.matmul(words, queries.T.reshape(groups, dim // groups, len(queries)))
    return (part[::2, :, None] + part[1::2, None]).reshape(groups // 2, 256, len(queries))


def scan(table: np.ndarray, packed: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Approximate scores (queries x rows) by table look-ups, one for each byte of two codes."""
    score, line = np.tile(base, (len(packed), 1)), np.empty((len(packed), len(base)), np.float32)
    for m in range(packed.shape[1]):
        score += np.take(table[m], packed[:, m], axis=0, out=line, mode="clip")
    return np.ascontiguousarray(score.T)


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in rising order."""
    if k >= score.shape[1]:
        return np.tile(np.arange(score.shape[1]), (len(score), 1))
    return np.sort(np.argpartition(-score, k - 1, axis=1)[:, :k], axis=1)


@dataclass
class Cell:
    """Rows scanned together: a list of an index, or a part of a list that outgrew its size."""

    rows: np.ndarray
    list_no: int
    part: int | None = None


def cells(vectors: np.ndarray, list_of: np.ndarray, list_rows: int) -> tuple[list[Cell], dict[int, np.ndarray]]:
    """The cells of a task, and for each list that was divided the centroids of its cells."""
    out, inner = [], {}
    for at in np.unique(list_of):
        rows = np.flatnonzero(list_of == at)
        parts = len(rows) // (2 * list_rows) + 1
        if parts == 1:
            out.append(Cell(rows, int(at)))
            continue
        x = vectors[rows]
        step = max(1, len(x) // (64 * parts))
        inner[int(at)] = centroids = _means(x[::step], x[:: max(1, len(x) // parts)][:parts].copy(), 4)
        near = _nearest(x, centroids, 1)[:, 0]
        out += [Cell(rows[near == c], int(at), c) for c in range(len(centroids))]
    return out, inner


def search(queries: np.ndarray, wanted: np.ndarray, vectors: np.ndarray, packed: np.ndarray, list_of: np.ndarray, index: Index,
           k: int, rerank: int = RERANK, list_rows: int = LIST_ROWS, inner_probes: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the best rows of each query in the lists it wants (query x list flags), earlier rows first in ties."""
    parts, inner = cells(vectors, list_of, list_rows)
    found: list[tuple] = []
    chosen = {at: _nearest(queries, c, min(inner_probes, len(c))) for at, c in inner.items()}
    for cell in parts:
        asking = wanted[:, cell.list_no] & (True if cell.part is None else (chosen[cell.list_no] == cell.part).any(1))
        codes, asking = packed[cell.rows], np.flatnonzero(asking)
        for a in range(0, len(asking) if len(cell.rows) else 0, 256):
            ask = asking[a:a + 256]
            q = queries[ask]
            few = _top(scan(tables(q, index.words), codes, q @ index.centroids[cell.list_no]), rerank)
            exact = np.matmul(vectors[cell.rows[few]], q[:, :, None])[:, :, 0]
            best = _top(exact, k)
            found.append((np.repeat(ask, best.shape[1]), cell.rows[np.take_along_axis(few, best, 1)].ravel(), np.take_along_axis(exact, best, 1).ravel()))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    query, row, cosine = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((row, -cosine, query))
    query, row, cosine = query[order], row[order], cosine[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    return query[place < k], row[place < k], cosine[place < k]


def to_fixed(x: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes: a float scale, then 16-bit numbers."""
    scale = np.abs(x).max(1, keepdims=True) / 32_767
    return np.hstack([scale.astype("<f4").view(np.uint8), np.rint(x / scale).astype("<i2").view(np.uint8)])


def from_fixed(raw: np.ndarray) -> np.ndarray:
    return _unit(np.ascontiguousarray(raw[:, 4:]).view("<i2"))


def _finite() -> Column:
    """Every number of the vector is finite and one at least is not 0."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return finite & F.exists("vector", lambda x: x != 0)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, vector) of finite vectors of the right length that are not all zero, each id once."""
    fit_for_use = vectors.where(F.col("id").isNotNull() & (F.size("vector") == dim)).where(_finite())
    return fit_for_use.groupBy("id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.pad(x, ((0, 0), (0, -dim % (2 * SUB))))  # whole bytes of codes; zeros change no cosine


def _bytes(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as one binary column."""
    flat, n, width = np.ascontiguousarray(rows), *rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _integers(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel().astype(np.int32)))


def _route(rows: DataFrame, dim: int, index: Index, probes: int) -> DataFrame:
    """id, v (direction), code, probes (nearest lists, best first) and asks (their groups, the one of the own list first)."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = to_fixed(_unit(_matrix(b.column(1), dim) + 0.0))
            x = from_fixed(raw)
            near = _nearest(x, index.centroids, probes)
            code = pack_codes(assign(x, x - index.centroids[near[:, 0]], index.words))
            asks = [list(dict.fromkeys(g)) for g in index.group_of[near].tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(raw), _binary(code), _integers(near), pa.array(asks, pa.list_(pa.int32()))],
                                             names=["id", "v", "code", "probes", "asks"])

    return rows.mapInArrow(route, "id string, v binary, code binary, probes array<int>, asks array<int>")


def _sample(vectors: DataFrame, dim: int, n: int, lists: int) -> np.ndarray:
    """At most FIT_ROWS unit vectors, about 64 for each list and 8,192 at least."""
    want = min(FIT_ROWS, max(8_192, 64 * lists))
    rows = vectors.where(F.col("id").isNotNull() & (F.size("vector") == dim) & _finite())
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, want / max(1, n)) * (1 << 20))).select("vector").limit(2 * want).toArrow()
    if not some.num_rows:
        some = rows.select("vector").limit(want).toArrow()
    return _unit(_matrix(some.column(0), dim)) if some.num_rows else np.zeros((0, dim), np.float32)


def nearest(vectors: DataFrame, dim: int, k: int = 5, probes: int = PROBES, rerank: int = RERANK, list_rows: int = LIST_ROWS, block: int = BLOCK,
            max_lists: int = MAX_LISTS) -> DataFrame:
    """vectors(id, vector) to id, other, cosine, place: the k most similar of each id, place 1 the most similar."""
    spark, slim = vectors.sparkSession, vectors.select(F.col("id").cast("string").alias("id"), "vector")
    n = vectors.count()
    lists = min(max_lists, max(1, round(n / list_rows)))
    sample = _sample(slim, dim, n, lists)
    if not len(sample):
        return spark.createDataFrame([], "id string, other string, cosine float, place int")
    index = fit(sample, lists)
    probes, bytes_v, bytes_c = min(probes, len(index.centroids)), 4 + 2 * sample.shape[1], len(index.words) // 2
    routed = cut(_route(usable(slim, dim), dim, index, probes).withColumn("h", F.unhex(F.md5("v"))))
    # a group limit: applied before the shuffle as well, so a direction with very many copies sends few rows to its task
    copies = W.partitionBy("h").orderBy("id")
    firsts = routed.select("h", "id").withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    full = cut(firsts.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("firsts")).where(F.size("firsts") == k + 1))
    n_full, heads, rest = full.count(), routed, None
    if n_full:
        marked = routed.join(F.broadcast(full), "h", "left") if n_full <= BROADCAST_ROWS else salted_join(routed, full, "h", "left")
        tail = F.coalesce(F.col("id") > F.col("firsts")[k], F.lit(False))
        rest = marked.where(tail).select("id", F.posexplode(F.slice("firsts", 1, k)).alias("pos", "other")).select(
            "id", "other", F.lit(1.0).cast("float").alias("cosine"), (F.col("pos") + 1).alias("place"))
        heads = marked.where(~tail)
    calls = heads.select(F.posexplode("asks").alias("pos", "task")).groupBy("task").agg(
        F.count(F.when(F.col("pos") == 0, 1)).alias("rows"), F.count(F.lit(1)).alias("asked"))
    sizes = [(r.task, -(-r.rows // block), -(-r.asked // (4 * block))) for r in calls.collect()]  # a row for each group, at most MAX_LISTS
    grid = F.broadcast(spark.createDataFrame([(t, p, u, p == u == 1) for t, p, u in sizes if p], "task int, parts int, turns int, alone boolean"))
    to = heads.select("id", "v", "code", "probes", F.posexplode("asks").alias("pos", "task")).join(grid, "task")
    count = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    as_data = to.where("pos = 0").select(
        "task", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(count("turns")).alias("turn"),
        F.when(F.col("alone"), 2).otherwise(0).alias("role"), "id", "v", "code", "probes")
    as_query = to.where("pos > 0 or not alone").select(
        "task", F.explode(count("parts")).alias("part"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("turns")).cast("int").alias("turn"),
        F.lit(1).alias("role"), "id", "v", F.lit(None).cast("binary").alias("code"), "probes")

    def look(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        role = t.column("role").to_numpy()
        data, asks = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        x, names = from_fixed(_bytes(t.column("v"), bytes_v)), np.array(t.column("id").to_pylist(), object)
        near = np.array(t.column("probes").to_pylist(), np.int32).reshape(len(role), -1)
        asks = asks[np.argsort(near[asks, 0], kind="stable")]
        wanted = np.zeros((len(asks), len(index.centroids)), bool)
        np.put_along_axis(wanted, near[asks].astype(np.int64), True, 1)
        query, row, cosine = search(x[asks], wanted, x[data], _bytes(t.column("code").take(data), bytes_c), near[data, 0], index, k + 1, rerank, list_rows)
        own, other = names[asks][query], names[data][row]
        keep = own != other
        return pa.table({"id": pa.array(own[keep], pa.string()), "other": pa.array(other[keep], pa.string()), "cosine": pa.array(cosine[keep], pa.float32())})

    found = as_data.union(as_query).groupBy("task", "part", "turn").applyInArrow(look, "id string, other string, cosine float")
    best = W.partitionBy("id").orderBy(F.desc("cosine"), "other")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return top.unionByName(rest) if rest is not None else top


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """Pairs of which one is among the nearest of the other, with at least this cosine; smaller id first, each once."""
    near = neighbours.where(F.col("cosine") >= least)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
