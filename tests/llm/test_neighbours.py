import numpy as np
import pytest

from cairnset.llm import neighbours as N


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    return (centres[rng.integers(0, 12, n)] + 0.5 * rng.standard_normal((n, dim))).astype(np.float32)


def brute(ids, x, k):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {ids[i]: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 6), ids[j])) if j != i][:k] for i in range(len(ids))}


@pytest.mark.parametrize("block", [64, 4096])
def test_recall_and_pairs(spark, block):
    x = clustered(1500, 16, 1)
    x[1400:1450] = x[:50] * 3 + 0.01  # nearly the same direction, another length
    ids = [f"c{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame(list(zip(ids, x.tolist(), ["clash"] * len(ids))), "id string, vector array<float>, other string")
    out = N.nearest(df, dim=16, k=5, probes=4, rerank=64, list_rows=200, block=block).collect()
    want = brute(ids, x, 5)
    got = {}
    for r in out:
        got.setdefault(r.id, []).append(r.other)
    assert all(len(set(v)) == 5 for v in got.values()) and len(got) == len(ids)
    assert sum(len(set(got[i]) & set(want[i])) for i in ids) >= 0.9 * 5 * len(ids)


def test_anisotropic_codes_cut_the_parallel_error():
    x = N._unit(clustered(3000, 32, 2))
    index = N.fit(x, 8)
    residual = x - index.centroids[N._nearest(x, index.centroids, 1)[:, 0]]
    rs = residual.reshape(len(x), 8, N.SUB)

    def parallel(eta):
        code = N.assign(x, residual, index.words, eta).astype(np.int64)
        left = rs - np.take_along_axis(index.words[None], code[:, :, None, None], 2)[:, :, 0]
        return float(((left.reshape(len(x), -1) * x).sum(1) ** 2).mean())

    assert parallel(N.ETA) < parallel(1.0)


def test_table_scan_equals_decoded_product():
    x = N._unit(clustered(400, 16, 3))
    index = N.fit(x, 2)
    at = N._nearest(x, index.centroids, 1)[:, 0]
    code = N.assign(x, x - index.centroids[at], index.words)
    decoded = np.take_along_axis(index.words[None], code[:, :, None, None].astype(np.int64), 2)[:, :, 0].reshape(len(x), -1)
    one = at == 0
    score = N.scan(N.tables(x[:20], index.words), N.pack_codes(code[one]), x[:20] @ index.centroids[0])
    assert np.allclose(score, x[:20] @ (index.centroids[0] + decoded[one]).T, atol=1e-4)


def test_identical_unusable_and_few_vectors(spark):
    rows = [(f"s{i:02d}", [1.0, 0.0, 0.0, 0.0]) for i in range(20)] + [("t", [0.0, 1.0, 0.0, 0.0]), ("t", [0.0, 1.0, 0.0, 0.0])]
    bad = [("z", [0.0] * 4), ("n", [float("nan"), 1.0, 0.0, 0.0]), ("short", [1.0]), ("none", None), ("hole", [1.0, None, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), ("empty", [])]
    df = spark.createDataFrame(rows + bad, "id string, vector array<float>")
    out = N.nearest(df, dim=4, k=3).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.place):
        got.setdefault(r.id, []).append((r.other, round(r.cosine, 4)))
    assert set(got) == {i for i, _ in rows}
    assert got["s00"] == [("s01", 1.0), ("s02", 1.0), ("s03", 1.0)] and got["s19"] == [("s00", 1.0), ("s01", 1.0), ("s02", 1.0)] and got["s05"] == got["s19"]
    assert got["t"] == [("s00", 0.0), ("s01", 0.0), ("s02", 0.0)]
    assert N.nearest(df.limit(0), dim=4).count() == 0
    assert N.nearest(df.where("id = 't'"), dim=4).count() == 0


def test_lists_that_outgrow_their_size_are_divided_in_their_task(spark):
    x = clustered(4000, 16, 4)
    ids = [f"c{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "id string, vector array<float>")
    got = {}
    for r in N.nearest(df, dim=16, k=5, list_rows=60, max_lists=12).collect():
        got.setdefault(r.id, []).append(r.other)
    want = brute(ids, x, 5)
    assert all(len(set(v)) == 5 for v in got.values()) and len(got) == len(ids)
    assert sum(len(set(got[i]) & set(want[i])) for i in ids) >= 0.9 * 5 * len(ids)


def test_fixed_point_directions_keep_the_cosine():
    x = N._unit(clustered(500, 64, 6))
    y = N.from_fixed(N.to_fixed(x))
    assert np.abs(x @ x.T - y @ y.T).max() < 1e-5 * 5
