import math

import pytest
from pyspark.sql import functions as F

from cairnset.functions import metrics as M
from cairnset.operators import retrieval as R
from cairnset.operators import symbols as G

DOCS = [(1, "alpha beta beta"), (2, "beta"), (3, "gamma alpha beta delta"), (4, None), (5, "")]


def test_bm25_matches_the_formula(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r.doc_id: r.score for r in R.fts_code(df, "beta ALPHA").collect()}
    docs = {i: (t or "").split() for i, t in DOCS}
    lens = {1: 3, 2: 1, 3: 4, 4: -1, 5: 0}
    assert set(got) == {1, 2, 3}
    # a null text counts as no words; the length of a null array is null and left out of the average
    avg = sum(v for k, v in lens.items() if k != 4) / 4
    for i in got:
        s = 0.0
        for term in ("beta", "alpha"):
            df_ = sum(term in d for d in docs.values())
            idf = math.log((5 - df_ + 0.5) / (df_ + 0.5))
            tf = docs[i].count(term)
            s += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens[i] / avg))
        assert got[i] == pytest.approx(s, abs=1e-9)


@pytest.mark.parametrize("q", ["", "  ", "\"", "'; drop", "a:b*", "(", "NEAR/3", "\0", "-", "^", "col:x", "%", "\\", "AND OR"])
def test_punctuation_never_fails(spark, q):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    notes = spark.createDataFrame([(1, "t", "b", ["x"])], "id long, title string, body string, tags array<string>")
    R.fts_code(df, q).collect(), R.fts_memory(notes, q).collect()


def test_phrase_is_contiguous_and_more_hits_rank_higher(spark):
    rows = [(1, "", "the final page of the final page", None), (2, "", "final the page", None), (3, "the final", "page", ["x"]), (4, "the final page", "", None)]
    got = [r.id for r in R.fts_memory(spark.createDataFrame(rows, "id long, title string, body string, tags array<string>"), "The FINAL page").collect()]
    assert set(got) == {1, 3, 4} and 2 not in got
    assert R.fts_memory(spark.createDataFrame(rows, "id long, title string, body string, tags array<string>"), "nonsense words here").count() == 0


def test_timeline_orders_the_best_hits_by_time(spark):
    rows = [(i, "note", "", "sync lease", None, "archived" if i % 2 else "active", 1, at) for i, at in enumerate([300, 100, 200])] + [(9, "note", "", "else", None, "active", 1, 150)]
    notes = spark.createDataFrame(rows, "id long, kind string, title string, body string, tags array<string>, status string, created_at long, valid_at long")
    assert [r["at"] for r in R.timeline(notes, "sync lease").collect()] == [100, 200, 300]


def test_int8_rounds_half_away_from_zero_and_orders_by_raw_distance(spark):
    df = spark.createDataFrame([(1, [0.5 / 127, -2.5 / 127, 2.0], 0.0), (2, [0.0, 0.0, 1.0], 1.0)], "vec_id long, embedding array<double>, graph_rank double")
    assert [r[0] for r in df.orderBy("vec_id").select(R.quantise_int8(F.col("embedding"))).collect()] == [[1, -3, 127], [0, 0, 127]]
    hits = R.knn_int8(df, [0.004, -0.02, 1.0], 5, rank="graph_rank").collect()
    assert [h.vec_id for h in hits] == [1, 2] and hits[0].distance > hits[1].distance  # the blend does not order


def test_rrf_ties_by_key(spark):
    a = spark.createDataFrame([(7, 1), (3, 2)], "k long, place int")
    b = spark.createDataFrame([(3, 1), (7, 2), (1, 3)], "k long, place int")
    got = [(r.k, round(r.score, 9)) for r in R.rrf([a, b], "k", 10).collect()]
    assert got == [(3, round(1 / 61 + 1 / 62, 9)), (7, round(1 / 61 + 1 / 62, 9)), (1, round(1 / 63, 9))]


def test_packing_skips_oversize_and_stops_early(spark):
    hits = spark.createDataFrame([(1, 50), (2, 100), (3, 45), (4, 4), (5, 1)], "rn int, tokens long")
    assert [r.rn for r in R.budget_pack(hits, 100, ["rn"]).orderBy("rn").collect()] == [1, 3]  # 5 left is under 10
    assert [r.rn for r in R.budget_pack(hits, 100, ["rn"], stop_below=0).orderBy("rn").collect()] == [1, 3, 4, 5]
    assert [r.rn for r in R.budget_pack(hits, 150, ["rn"]).orderBy("rn").collect()] == [1, 2]
    assert R.budget_pack(hits.limit(0), 100, ["rn"]).count() == 0


def brute_rank(edges, personal=None, rounds=20, d=0.85):
    real = [(s, t) for s, t in edges if s != t]
    nodes = sorted({x for e in edges for x in e})
    n = len(nodes)
    jump = {x: 1 / n for x in nodes} if personal is None else {x: personal.get(x, 0) / sum(personal.values()) for x in nodes}
    rank = {x: 1 / n for x in nodes}
    for _ in range(rounds):
        lost = sum(rank[x] for x in nodes if not any(s == x for s, _ in real))
        new = {x: ((1 - d) + d * lost) * jump[x] for x in nodes}
        for s, t in real:
            new[t] += d * rank[s] / sum(a == s for a, _ in real)
        rank = new
    return rank


EDGES = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "c"), ("d", "d"), ("e", "a")]


@pytest.mark.parametrize("personal", [None, {"a": 2.0, "d": 1.0}])
def test_pagerank_bag_self_loops_and_dangling(spark, personal):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    p = None if personal is None else spark.createDataFrame(list(personal.items()), "node string, weight double")
    got = {r.node: r["rank"] for r in G.pagerank(e, personal=p).collect()}
    want = brute_rank(EDGES, personal)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert sum(got.values()) == pytest.approx(1.0)
    assert G.pagerank(e.limit(0)).count() == 0


def test_linear_rag_brings_in_related_chunks(spark):
    pool = spark.createDataFrame([(1, 1.0), (2, 0.3), (3, 0.0)], "chunk long, similarity double")
    mentions = spark.createDataFrame([(1, "lease"), (9, "lease"), (2, "quota"), (9, "quota"), (3, "cold"), (8, "cold")], "chunk long, symbol string")
    got = [r.chunk for r in G.linear_rag(pool, mentions, 10).collect()]
    assert got[0] == 1 and 9 in got and 8 not in got
    calm = G.linear_rag(spark.createDataFrame([(1, 0.1), (2, 0.2)], pool.schema), mentions, 10)
    assert [r.chunk for r in calm.collect()] == [2, 1]


def test_mention_tokens_and_calls(spark):
    code = "// not_this\nfn run_all(abc) {\n  let s = \"in_string\"; /* block\n comment_word */ do_work(x1, 12345, ab);\n  print(do_work(run_all(abc)));\n}"
    df = spark.createDataFrame([("f.rs", "run_all", code), ("g.rs", None, code), ("h.rs", "x", None)], "path string, name string, content string")
    assert df.where("path = 'f.rs'").select(G.mention_tokens(F.col("content"))).first()[0] == ["run_all", "abc", "do_work", "print"]
    # built-in names are those of the language
    assert {(r.source_name, r.target_name) for r in G.call_edges(df).collect()} == {("run_all", "do_work"), ("run_all", "print")}
    py = spark.createDataFrame([("f.py", "run_all", "def run_all():  # gone(1)\n    print(do_work(1)) // kept(2)\n")], df.schema)
    assert {(r.source_name, r.target_name) for r in G.call_edges(py).collect()} == {("run_all", "do_work"), ("run_all", "kept")}


def test_html_targets(spark):
    df = spark.createDataFrame([(1, "<a href='x.html'>a</a><img SRC=\" y.png \"><a href=\"#top\"><a href=''><img src=data:abc>")], "id long, text string")
    assert sorted(r.target_name for r in G.html_edges(df).collect()) == ["x.html", "y.png"]


def test_conflicts_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 6))
    x = np.concatenate([x, x[:20] + 0.01, np.repeat(x[:1], 9, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in R.conflicts(df, df, 0.9, limit=3).collect():
        got.setdefault(r.id_a, []).append((r.place, r.id_b))
    for i in range(len(x)):
        near = sorted((round(float(np.linalg.norm(x[i] - x[j])), 9), j) for j in range(len(x)) if j != i and np.linalg.norm(x[i] - x[j]) <= 0.1)[:3]
        assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in near]
    assert R.conflicts(df.limit(0), df).count() == 0 and R.conflicts(df, df.limit(0)).count() == 0
    earlier = {r.id: r.nearest for r in R.nearest_earlier(df, df, 0.1).collect()}
    for i in range(len(x)):
        near = [float(np.linalg.norm(x[i] - x[j])) for j in range(i)]
        assert (min(near, default=1) < 0.1) == (i in earlier)


def test_metrics(spark):
    from math import comb

    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "z", 1)], "query string, item string, place int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "x"), ("q", "b")], "query string, item string")
    got = {r["query"]: (r.recall, r.precision, r.reciprocal_rank) for r in M.ranking_metrics(ranked, relevant, 2).collect()}
    assert got == {"q": (0.5, 0.5, 0.5), "r": (None, 0.0, 0.0)}
    for b, c in [(0, 0), (5, 1), (30, 12), (400, 350)]:
        p = spark.range(1).select(M.binomial_two_sided(F.lit(b), F.lit(c))).first()[0]
        n, low = b + c, min(b, c)
        want = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(low + 1)) / 2 ** n)
        assert p == pytest.approx(want, rel=1e-6)
    low, high = M.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 0.0)
    boot = M.bootstrap(spark.createDataFrame([(i, "g", float(i % 2)) for i in range(400)], "id long, g string, v double"), ["g"], "v", rounds=200).first()
    assert 0.42 < boot.low < 0.5 < boot.high < 0.58


def test_stored_index_gives_the_same_scores(spark, tmp_path):
    from cairnset.operators import index as I

    df = spark.createDataFrame(DOCS + [(6, "beta Beta BETA, gamma"), (7, "漢字 beta_x")], "doc_id long, text string")
    I.write_index(df, str(tmp_path / "i"), buckets=4)
    for q in ("beta ALPHA", "gamma", "nothing", "", "漢字"):
        want = {r.doc_id: round(r.score, 9) for r in R.fts_code(df, q).collect()}
        got = {r.doc_id: round(r.score, 9) for r in I.search_index(spark, str(tmp_path / "i"), q).collect()}
        assert got == want, q
