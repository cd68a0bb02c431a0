import random

import numpy as np
import pytest

from cairnset.llm import mixing as M
from cairnset.llm import packing as P
from cairnset.llm import tokens as K


def brute_best_fit(sizes, cap):
    rooms, out = [], []
    for s in sizes:
        fits = [r for r in rooms if r >= s]
        if fits:
            r = min(fits)
            rooms[rooms.index(r)] -= s
        else:
            r = cap
            rooms.append(cap - s)
        out.append(r)
    return len(rooms), out


@pytest.mark.parametrize("cap", [1, 7, 64, 1000])
def test_tree_is_best_fit(cap):
    rng = random.Random(cap)
    sizes = sorted((rng.randrange(0, cap + 1) for _ in range(500)), reverse=True)
    fit = P.BestFit(cap)
    used = {}
    for s in sizes:
        w = fit.place(s)
        used[w] = used.get(w, 0) + s
    assert fit.windows == brute_best_fit(sizes, cap)[0] and max(used.values()) <= cap


@pytest.mark.parametrize("shard_items", [20, 1000])
def test_windows_hold_everything_once(spark, shard_items):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, None, 3, 50, 99, 100, 101, 250, 1000]), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "item_id long, size long, window_id string")
    out = P.pack(df, [("w", 100), ("v", 70)], 300, shard_items).collect()
    for name, cap in (("w", 100), ("v", 70)):
        mine = [r for r in out if r.limit_name == name]
        room, spans = {}, {}
        for r in mine:
            room[r.window_id] = room.get(r.window_id, 0) + r.size
            spans.setdefault(r.item_id, []).append((r.start, r.size))
        assert max(room.values()) <= cap and len(spans) == 300
        for i, total, _ in rows:
            pieces = sorted(spans[i])
            assert sum(s for _, s in pieces) == (total or 0) and (len(pieces) == 1 or total > cap)
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
    assert P.pack(df.limit(0), [("w", 100)], 0).count() == 0


def test_token_counts(spark):
    texts = ["hello world", "", None, "<|endoftext|>", "é漢字\U0001f469‍\U0001f4bb", "x" * 300_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(K.n_tokens(K.F.col("text"))).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1 and got[5] >= 300_000 // 128
    assert got == [len(K.encoder(K.DEFAULT_TOKENIZER).encode_ordinary(t)) if t else 0 for t in texts]


def test_splitting_tree_quotas_are_exact():
    counts = np.array([40, 3, 0, 17])
    for shards in (1, 2, 7):
        q = M.split_quotas(counts, shards, np.random.default_rng(1))
        assert (q.sum(0) == counts).all() and (q >= 0).all() and np.ptp(q.sum(1)) <= shards


def test_mixture_shares_repeats_and_disjoint_draws(spark):
    rng = random.Random(5)
    rows = [(i, ["big", "big", "big", "small", "other"][i % 5], rng.choice([0, 1, 5, 20, 40]), "x") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, shard string").select("doc_id", "source", "n_tokens")
    targets = {"big": (0.5, 1), "small": (0.4, 3), "void": (0.1, 2), "other": (0.0, 5)}
    out = M.mixture(docs, targets, blocks=16, shard_tokens=5000).collect()
    tokens, uses = {}, {}
    for r in out:
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
        uses.setdefault(r.doc_id, []).append(r.use_no)
    total = sum(tokens.values())
    assert set(tokens) == {"big", "small"}
    assert abs(tokens["big"] / total - 5 / 9) < 0.003 and abs(tokens["small"] / total - 4 / 9) < 0.003
    kind = {i: s for i, s, _, _ in rows}
    assert all(len(set(u)) == len(u) and len(u) <= targets[kind[d]][1] for d, u in uses.items())
    for s in {r.shard for r in out}:
        assert sorted(r.position for r in out if r.shard == s) == list(range(1, sum(r.shard == s for r in out) + 1))
    assert M.mixture(docs.limit(0), targets).count() == 0


def test_source_names(spark):
    df = spark.createDataFrame([("Source-Code ",), ("source code",), (None,)], "s string")
    assert [r[0] for r in df.select(M.source_name(K.F.col("s"))).collect()] == ["source_code", "source_code", None]
