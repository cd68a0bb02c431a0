import numpy as np
import pytest

from cairnset.llm import quantiles as Q


@pytest.mark.parametrize("seed", range(4))
def test_rank_error_after_many_merges(seed):
    rng = np.random.default_rng(seed)
    values = [np.abs(rng.standard_normal(4000) * 50), np.full(3000, 7.0), rng.integers(0, 9, 5000) * 1.0, np.array([1e12, 0.0])][: seed + 1]
    data, eps = np.concatenate(values), 0.02
    k = Q._k(eps)
    parts = np.array_split(rng.permutation(data), 9)
    nodes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for p in parts:
        a, c = Q.compress(Q.encode(p), np.ones(len(p), np.int64), np.array([len(p) // k]))
        nodes, counts = np.r_[nodes, a], np.r_[counts, c]
        nodes, counts = Q.compress(nodes, counts, np.array([int(counts.sum()) // k]))
    assert counts.sum() == len(data) and len(nodes) <= 3 * k + 1
    for q, (v, unsure) in zip([0.01, 0.5, 0.9, 0.99], Q.quantiles(nodes, counts, [0.01, 0.5, 0.9, 0.99])):
        low, high = (data < v).sum(), (data <= v * (1 + 2**-20)).sum()
        assert low - eps * len(data) - 1 <= q * len(data) <= high + eps * len(data) + 1
        assert unsure <= 2 * eps * len(data)


def test_spark_groups_nulls_and_bad_values(spark):
    rows = [("r1", None, " A ", "m", 5.0, 10), ("r1", None, " A ", "m", 5.0, 10), ("r2", None, "a", "M", float("nan"), None),
            ("r3", None, "a", "m", -1.0, 4), ("r4", None, None, "m", 2.0, 3), ("r5", None, "b", "m", None, -5), (None, None, "c", "m", 1.0, None), (None, None, "c", "m", 1.0, None)]
    df = spark.createDataFrame(rows, "run_id string, received_on date, condition string, model string, wall_seconds double, input_tokens long")
    runs = Q.once_per_run(df.withColumn("n", Q.F.lit(1)).withColumn("measure", Q.F.lit("x")))
    out = Q.read_quantiles(Q.merge_digests(Q.digest_groups(runs, ["condition", "model"], ["wall_seconds", "input_tokens"], 0.01), ["condition", "model"], 0.01), ["condition", "model"], [0.5]).collect()
    got = {(r.condition, r.model, r.measure): (r.n, r.estimate) for r in out}
    assert got == {("a", "m", "wall_seconds"): (1, 5.0), ("a", "m", "input_tokens"): (2, 4.0),
                   (None, "m", "wall_seconds"): (1, 2.0), (None, "m", "input_tokens"): (1, 3.0), ("c", "m", "wall_seconds"): (2, 1.0)}
    assert Q.digest_groups(runs.limit(0), ["condition"], ["wall_seconds"], 0.01).count() == 0
