"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by a hash into blocks of about `BLOCK_TOKENS` tokens (larger ones only beyond `MAX_BLOCKS` blocks
in all, a millionth of the data each); only the block sizes reach the driver. The largest mixture is taken in which every source meets its share without using a
document more than max_repeats times: whole passes over all blocks, then blocks in permuted order, then a part of one
block, document by document. The draws are divided among the output shards by a tree: at each node the left half of the
shards gets a multivariate-hypergeometric share of what the node holds, so the quotas of all shards add up exactly. Blocks
are drawn without overlap, first uses and repeats in mixed order, and the documents of a shard are shuffled inside it.

Sources without a target, or with share 0, are not used; a listed source without tokens cannot be met: the other shares
are scaled to sum to 1 and the report shows what was reached. Null sources are not listed, rows without a doc_id cannot be
drawn, null token counts count as 0. Repeated calls agree (seed).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnset.functions.text import source_name

BLOCK_TOKENS, MAX_BLOCKS = 1 << 18, 1 << 20
#: Draws that may be broadcast; more are joined by a shuffle on source and block.
BROADCAST_DRAWS = 100_000


def split_quotas(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) integer quotas whose columns sum to `counts`, split down a binary tree of shards."""
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, counts.astype(np.int64))]
    while todo:
        low, high, held = todo.pop()
        if high - low == 1:
            out[low] = held
            continue
        mid = (low + high) // 2
        m = round(int(held.sum()) * (mid - low) / (high - low))
        left = rng.multivariate_hypergeometric(held, m, method="marginals") if held.sum() else held
        todo += [(low, mid, left), (mid, high, held - left)]
    return out


def plan_draws(blocks: dict[str, np.ndarray], targets: dict[str, tuple[float, int]], shard_tokens: int, seed: int, total: float | None = None) -> list[tuple]:
    """(source, block, use_no, shard, budget) of every draw; budget is null where the whole block is taken."""
    rng = np.random.default_rng(seed)
    usable = {s: (share, reps) for s, (share, reps) in targets.items() if share > 0 and reps > 0 and s in blocks and blocks[s].sum() > 0}
    if not usable:
        return []
    scale = sum(share for share, _ in usable.values())
    most = min(blocks[s].sum() * reps * scale / share for s, (share, reps) in usable.items())
    size = most if total is None else min(most, total)
    draws = {}
    for s in sorted(usable):
        share, reps = usable[s]
        have, want = int(blocks[s].sum()), size * share / scale
        passes = min(reps, int(want // have + 1e-12))
        own = [(b, u + 1, None) for u in range(passes) for b in rng.permutation(len(blocks[s])).tolist()]
        left = want - passes * have
        if passes < reps and left >= 1:
            for b in rng.permutation(len(blocks[s])).tolist():
                if left <= 0:
                    break
                own.append((b, passes + 1, None if blocks[s][b] <= left else int(left)))
                left -= blocks[s][b]
        draws[s] = [own[i] for i in rng.permutation(len(own)).tolist()]
    names = list(draws)
    counts = np.array([len(draws[s]) for s in names])
    shards = int(min(max(1, math.ceil(size / shard_tokens)), counts.sum()))
    quotas, used, out = split_quotas(counts, shards, rng), dict.fromkeys(names, 0), []
    for shard in range(shards):
        for s, q in zip(names, quotas[shard].tolist()):
            out += [(s, b, u, shard, left) for b, u, left in draws[s][used[s]:used[s] + q]]
            used[s] += q
    return out


def mixture(docs: DataFrame, targets: dict[str, tuple[float, int]], blocks: int | None = None, shard_tokens: int = 2_000_000, seed: int = 7, total: float | None = None) -> DataFrame:
    """docs(doc_id, source, n_tokens) to shard, position, source, doc_id, use_no, n_tokens. `docs` is read several times.

    `blocks`: a fixed number of blocks of each source instead of one that follows its tokens.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", "source", "n_tokens").where("doc_id is not null")
    listed = slim.where(F.col("source").isin(list(targets)))
    held = {r.source: r.n or 0 for r in listed.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per listed source
    room = max(BLOCK_TOKENS, -(-sum(held.values()) // MAX_BLOCKS))
    n_blocks = {s: blocks or max(1, -(-n // room)) for s, n in held.items()} or {"": 1}
    parts = F.create_map(*[F.lit(x) for p in n_blocks.items() for x in p])[F.col("source")]
    listed = listed.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), parts).cast("int"))
    sizes: dict[str, np.ndarray] = {}
    found = listed.groupBy("source", "block").agg(F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n")).toArrow()  # at most MAX_BLOCKS rows and one more per source
    for s, b, n in zip(*(found.column(c).to_pylist() for c in ("source", "block", "n"))):
        sizes.setdefault(s, np.zeros(n_blocks[s], np.int64))[b] = n
    plan = plan_draws(sizes, targets, shard_tokens, seed, total)
    draws = spark.createDataFrame(plan, "source string, block int, use_no int, shard int, budget long")
    drawn = listed.join(F.broadcast(draws) if len(plan) <= BROADCAST_DRAWS else draws, ["source", "block"]).withColumn("mixed", F.xxhash64("doc_id", "use_no", F.lit(seed + 1)))
    whole = drawn.where("budget is null")
    running = W.partitionBy("source", "block", "use_no").orderBy("mixed", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    part = drawn.where("budget is not null").withColumn("sum", F.sum("n_tokens").over(running)).where(F.col("sum") - F.col("n_tokens") / 2 <= F.col("budget")).drop("sum")
    place = F.row_number().over(W.partitionBy("shard").orderBy("mixed", "doc_id", "use_no"))
    return whole.unionByName(part).select("shard", place.alias("position"), "source", "doc_id", "use_no", "n_tokens")
