import random

import pytest

from cairnset.operators import hierarchy as H


def brute(parent):
    out = {}
    for n in parent:
        seen, at = [n], n
        while at in parent:
            at = parent[at]
            if at in seen:
                out[n] = (min(seen[seen.index(at):]), None, True)
                break
            seen.append(at)
        else:
            out[n] = (at, len(seen) - 1, False)
    return out


def make(seed, n):
    rng = random.Random(seed)
    parent = {i: rng.randrange(max(0, i - 12), i) for i in range(1, n) if rng.random() < 0.9}
    for base, length in ((n, 1), (n + 10, 2), (n + 20, 7)):  # a note replacing itself, and longer cycles with tails
        for i in range(length):
            parent[base + i] = base + (i + 1) % length
        parent[base + 9] = base
        parent[base + 8] = base + 9
    return parent


@pytest.mark.parametrize("max_task_rows", [7, 50, 100000])
def test_roots_match_brute_force(spark, max_task_rows):
    parent = make(3, 260)
    links = spark.createDataFrame(list(parent.items()), "node long, parent long")
    got = {r.node: (r.root, r.depth, r.never_ends) for r in H.forest_roots(links, max_task_rows).collect()}
    assert got == brute(parent)


@pytest.mark.parametrize("max_task_rows", [5, 1000])
def test_paths_in_small_and_large_trees(spark, max_task_rows):
    parent = make(5, 120)
    links = spark.createDataFrame(list(parent.items()), "node long, parent long")
    roots = H.forest_roots(links)
    got = {r.node: r.path for r in H.forest_paths(links, roots, max_task_rows).collect()}
    want = {}
    for n, (root, depth, loops) in brute(parent).items():
        if not loops:
            path = [n]
            while path[-1] != root:
                path.append(parent[path[-1]])
            want[n] = path[::-1]
    assert got == want


@pytest.mark.parametrize("max_task_rows", [40, 300, 1000000])
def test_loops_whose_feeders_lie_elsewhere(spark, max_task_rows):
    parent = {i: i // 3 for i in range(1, 1300)}
    parent |= {5000: 5000} | {5001 + i: 5000 for i in range(34)} | {6000 + i: 6001 + i for i in range(40)} | {6040: 6020}
    parent |= {7000 + i: 7000 + (i + 1) % 900 for i in range(900)} | {8000 + i: 7000 + 9 * i for i in range(100)}
    links = spark.createDataFrame(list(parent.items()), "node long, parent long")
    got = {r.node: (r.root, r.depth, r.never_ends) for r in H.forest_roots(links, max_task_rows).collect()}
    assert got == brute(parent)


def test_links_drop_nulls_unknown_ends_and_repeats(spark):
    nodes = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "id long")
    links = spark.createDataFrame([(1, -9), (1, 2), (1, 2), (2, 9), (9, 1), (None, 1), (3, None), (3, 3)], "node long, parent long")
    assert sorted(map(tuple, H.parent_links(nodes, links).collect())) == [(1, 2), (3, 3)]


def test_empty_forest(spark):
    links = spark.createDataFrame([], "node long, parent long")
    roots = H.forest_roots(links)
    assert roots.count() == 0 and H.forest_paths(links, roots).count() == 0


@pytest.mark.parametrize("max_task_rows", [5, 1000])
def test_paths_and_descendants_on_and_below_cycles(spark, max_task_rows):
    parent = make(5, 120)
    links = spark.createDataFrame(list(parent.items()), "node long, parent long")
    want = {}
    for n in parent:
        path = [n]
        while path[-1] in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        want[n] = path[::-1]
    paths = H.all_paths(links, H.forest_roots(links), max_task_rows)
    assert {r.node: r.path for r in paths.collect()} == want
    pairs = sorted((a, n, len(p) - 1 - i) for n, p in want.items() for i, a in enumerate(p[:-1]))
    assert sorted(map(tuple, H.descendants(paths).collect())) == pairs


def test_hierarchy_has_a_row_for_every_note(spark, tmp_path):
    from cairnset.plans import dealt

    notes = [(1, None), (2, 1), (3, 2), (3, 2), (4, None), (5, 5), (6, 5), (None, None)]
    spark.createDataFrame(notes, "id long, superseded_by long").write.parquet(str(tmp_path / "notes.parquet"))
    spark.createDataFrame([], "from_id long, to_id long, kind string").write.parquet(str(tmp_path / "memory_edges.parquet"))
    got = sorted(tuple(r) for r in dealt.p3_hierarchy(spark, str(tmp_path)).collect())
    assert got == [
        (1, None, 1, 0, "1", False, 2), (2, 1, 1, 1, "1/2", False, 1), (3, 2, 1, 2, "1/2/3", False, 0), (4, None, 4, 0, "4", False, 0),
        (5, 5, 5, None, "5", True, 1), (6, 5, 5, None, "5/6", True, 0)]
