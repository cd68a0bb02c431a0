import random

import pytest

from cairnset.llm import survivors as V

SCHEMA = ("id long, kind string, title string, body string, tags array<string>, linked_files array<string>, created_at long, status string, "
          "source_ref string, valid_at long, remote_id string, copy_key string, t int")


def brute(rows):
    """Survivor, fields and number of layers of one group, over all its copies."""
    def clean(xs, lower):
        out = []
        for x in xs or []:
            x = " ".join(x.split()).lower() if x and lower else (x or "").strip()
            if x and x not in out:
                out.append(x)
        return out or None
    cand = []
    for r in rows:
        d = dict(id=r[0], tags=clean(r[4], True), linked_files=clean(r[5], False), a=r[6] // 1000 if r[6] >= 10**11 else r[6],
                 t=int(r[7].strip().lower() == "active"), source_ref=r[8] or None, valid_at=r[9], remote_id=r[10])
        mask = tuple(d[f] is not None for f in V.FIELDS)
        d["f"] = sum(mask)
        cand.append(d)
    left, layer = sorted(cand, key=lambda d: (-d["t"], -d["f"], -d["a"], d["id"])), 0
    order = []
    vec = lambda d: (d["t"], d["f"], d["a"])
    while left:
        layer += 1
        top = [d for d in left if not any(all(x >= y for x, y in zip(vec(o), vec(d))) and vec(o) != vec(d) for o in left)]
        order += top
        left = [d for d in left if d not in top]
    return order[0]["id"], {f: next((d[f] for d in order if d[f] is not None), None) for f in V.FIELDS}, layer


def test_against_brute_force(spark):
    rng, rows = random.Random(8), []
    for i in range(400):
        g = rng.randrange(25)
        rows.append((i, rng.choice(["Note", "note "]), f"Title  {g}", rng.choice([f"a\n b {g}", f"A b {g}"]), rng.choice([None, [], [" "], ["Ui ", None, "ui"], ["perf"]]),
                     rng.choice([None, [""], ["src/a.rs"]]), rng.choice([100, 200, 300, 200_000_000_000_000]), rng.choice(["active", " Active", "archived"]),
                     rng.choice([None, "", "ref"]), rng.choice([None, 5, 6]), rng.choice([None, f"r{i}"]), "clash", 9))
    df = spark.createDataFrame(rows, SCHEMA)
    got = V.survivors(df.union(df.limit(30))).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    assert len(got) == len(groups)
    for r in got:
        mine = next(g for g in groups.values() if any(x[0] == r.first_id for x in g))
        survivor, fields, layers = brute(mine)
        assert (r.first_id, r.last_id) == (min(x[0] for x in mine), max(x[0] for x in mine))
        assert (r.survivor_id, r.layers) == (survivor, layers)
        assert {f: r[f] for f in V.FIELDS} == fields


@pytest.mark.parametrize("gather", [4, 64])
def test_layers_of_all_copies(spark, monkeypatch, gather):
    monkeypatch.setattr(V, "GATHER", gather)
    four = [(1, "n", "four", "b", None, None, 1000, "active", None, None, None, "x", 0), (2, "n", "four", "b", ["k"], None, 800, "active", "ref", None, None, "x", 0),
            (3, "n", "four", "b", ["k"], None, 700, "active", None, None, "Y", "x", 0), (4, "n", "four", "b", None, None, 900, "active", None, None, "Z", "x", 0)]
    rng, rows = random.Random(2), list(four)
    for i in range(10, 700):
        g = rng.randrange(3)
        rows.append((i, "n", f"g{g}", "b", rng.choice([None, None, ["k"]]), rng.choice([None, None, ["f"]]), rng.randrange(0, 500_000, rng.choice([1, 20_000, 100_000])), rng.choice(["active", "archived", "archived"]),
                     rng.choice([None, None, f"ref{i}"]), rng.choice([None, None, i]), rng.choice([None, None, None, f"r{i}"]), "x", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    out = {r.title: r for r in V.survivors(df.union(df.limit(20))).collect()}
    assert set(out) == set(groups) and out["four"].remote_id == "Z"
    for title, mine in groups.items():
        survivor, fields, layers = brute(mine)
        r = out[title]
        assert (r.survivor_id, r.layers, r.candidates) == (survivor, layers, len({(x[7] == "active", x[6], *[bool(x[i]) for i in (4, 5, 8, 9, 10)]) for x in mine}))
        assert {f: r[f] for f in V.FIELDS} == fields


def test_nulls_and_empty(spark):
    rows = [(1, None, None, None, None, None, None, None, None, None, None, "x", 0), (2, None, "", " ", None, None, None, None, None, None, None, "x", 0), (None, "a", "b", "c", None, None, 1, "active", None, None, None, "x", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = V.survivors(df).collect()
    assert [(r.first_id, r.survivor_id, r.created_at, r.tags) for r in out] == [(1, 1, None, None)]
    assert V.survivors(df.limit(0)).count() == 0
