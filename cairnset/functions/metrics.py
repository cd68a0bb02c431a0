"""Retrieval and experiment metrics as aggregates and column arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnset.session import cut


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """ranked(query, item, place), relevant(query, item): recall@k (null without relevant items), precision@k, reciprocal rank."""
    total = relevant.distinct().groupBy("query").agg(F.count(F.lit(1)).alias("n_relevant"))
    hit = ranked.join(relevant.distinct().withColumn("hit", F.lit(1)), ["query", "item"], "left")
    got = hit.groupBy("query").agg(
        F.count(F.when((F.col("place") <= k) & F.col("hit").isNotNull(), 1)).alias("hits"), F.least(F.lit(k), F.count(F.lit(1))).alias("shown"), F.min(F.when(F.col("hit").isNotNull(), F.col("place"))).alias("first"))
    return got.join(total, "query", "left").select(
        "query", F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).alias("recall"), (F.col("hits") / F.col("shown")).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def set_prf(found: DataFrame, truth: DataFrame, by: str, item: str) -> DataFrame:
    """Precision (0 if nothing was found), recall (1 if nothing was to be found) and F1 of two sets per group."""
    f, t = found.select(by, item).distinct().withColumn("f", F.lit(1)), truth.select(by, item).distinct().withColumn("t", F.lit(1))
    g = f.join(t, [by, item], "full_outer").groupBy(by).agg(F.count("f").alias("nf"), F.count("t").alias("nt"), F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("both"))
    p = F.when(F.col("nf") == 0, 0.0).otherwise(F.col("both") / F.col("nf"))
    r = F.when(F.col("nt") == 0, 1.0).otherwise(F.col("both") / F.col("nt"))
    return g.select(by, p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c at even odds, at most 1; by log factorials, so it holds for large counts."""
    n, low = b + c, F.least(b, c)
    # one pass: the log of each term follows from the one before, C(n, i) = C(n, i - 1) * (n - i + 1) / i
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s.term + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (s.sum + F.exp(term)).alias("sum"))

    tail = F.aggregate(F.when(low > 0, F.sequence(F.lit(1).cast("long"), low.cast("long"))).otherwise(F.array().cast("array<bigint>")), start, step).sum
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(a: DataFrame, b: DataFrame, key: list[str], outcome: str) -> DataFrame:
    """Paired 2x2 counts of two runs and the exact p of their difference."""
    pairs = a.select(*key, F.col(outcome).alias("a")).join(b.select(*key, F.col(outcome).alias("b")), key)
    n = lambda x, y: F.count(F.when((F.col("a") == x) & (F.col("b") == y), 1))
    t = pairs.agg(n(True, True).alias("both"), n(True, False).alias("only_a"), n(False, True).alias("only_b"), n(False, False).alias("neither"))
    return t.withColumn("p", binomial_two_sided(F.col("only_a"), F.col("only_b")))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval; (0, 0) without trials."""
    p = hits / n
    mid, span = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    edge = lambda x: F.when(n == 0, 0.0).otherwise(x / (1 + z * z / n))
    return edge(mid - span), edge(mid + span)


def exact_median(df: DataFrame, by: list[str], value: str, held: int = 1_000_000) -> DataFrame:
    """by, median: the exact median of each group (null and NaN left out), whatever its size.

    Equal values are counted first. Up to `held` different ones in all, one aggregate holds them; of more, the counts are
    range-partitioned by (group, value) and running counts start from the sums of the partitions before, so the values of
    a hot group lie in as many tasks as they need and none is held in memory. Both give the same medians.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = cut(counts)
    if counts.count() <= held:
        return counts.groupBy(*by).agg(F.percentile("__v", F.lit(0.5), F.col("__n")).alias("median"))
    dealt = cut(counts.repartitionByRange(*by, "__v").sortWithinPartitions(*by, "__v").withColumn("__p", F.spark_partition_id()))
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in by])
    dealt = dealt.withColumn("__k", key)
    # a row for each group in each of its partitions
    parts = dealt.groupBy("__p", "__k", *by).agg(F.sum("__n").alias("__m"))
    upto = W.partitionBy("__k", *by).orderBy("__p").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = parts.select(F.col("__p").alias("__p2"), F.col("__k").alias("__k2"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], (F.sum("__m").over(upto) - F.col("__m")).alias("__start"),
                          F.sum("__m").over(W.partitionBy("__k", *by)).alias("__total"))
    same = [F.col("__p") == F.col("__p2"), F.col("__k") == F.col("__k2"), *[F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)]]
    rows = dealt.join(starts, same).select(*by, "__p", "__v", "__n", "__start", "__total")
    running = W.partitionBy("__p", *by).orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("__end", F.col("__start") + F.sum("__n").over(running))
    holds = lambda at: (F.col("__end") - F.col("__n") <= at) & (at < F.col("__end"))
    low, high = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    return placed.where(holds(low) | holds(high)).groupBy(*by).agg(((F.min("__v") + F.max("__v")) / 2).alias("median"))


def bootstrap(df: DataFrame, by: list[str], value: str, rounds: int = 200, seed: int = 3) -> DataFrame:
    """Percentile interval of the mean from Poisson resampling, every weight a hash of (row, round): no row is gathered anywhere."""
    row = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    hashed = df.select(*by, F.col(value).cast("double").alias("__v"), row.alias("__h")).where(F.col("__v").isNotNull())
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    # the chance of at most 0, 1, ... draws of a row at one draw a row on average
    upto = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)])

    def partial(frames):
        for pdf in frames:
            for key, part in pdf.groupby(by, dropna=False, sort=False):
                x = part["__h"].to_numpy().astype(np.uint64)[:, None] + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(upto, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), "right")
                yield pd.DataFrame({c: pd.Series([k] * rounds, dtype=object) for c, k in zip(by, key)} | {"round": np.arange(1, rounds + 1), "w": w.sum(0), "s": (w * part["__v"].to_numpy()[:, None]).sum(0)})

    # a batch gives one row for each of its groups and rounds, whatever its size
    sums = hashed.mapInPandas(partial, schema + ", round long, w long, s double").groupBy(*by, "round").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    q = F.percentile(F.col("s") / F.nullif(F.col("w"), F.lit(0)), F.array(F.lit(0.025), F.lit(0.975)))
    return sums.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
