"""Specifications, sequential harvests, remote notes, collapsed copies, packing by kind, provenance."""
import pytest
from pyspark.sql import functions as F

from cairnset.functions import harvest as H
from cairnset.operators import notes as N
from cairnset.operators import retrieval as R
from cairnset.operators import specs as S
from cairnset.plans import reads


def test_specs_by_prefix(spark):
    files = spark.createDataFrame([("src/a.py", 50), ("SRC/b.py", 60), ("srcx.py", 70), ("docs/s.md", 40), ("docs/t.md", 90), (None, 1)], "path string, indexed_at long")
    specs = spark.createDataFrame([(1, "docs/s.md", "S"), (2, "docs/t.md", "T"), (3, "docs/none.md", "N")], "spec_id int, path string, title string")
    links = spark.createDataFrame([(1, "src/"), (1, "src/"), (2, "src/a.py"), (3, "src"), (2, None)], "spec_id int, linked_path string")
    assert sorted(map(tuple, S.specs_for_files(files, specs, links).collect())) == [
        ("src/a.py", "docs/none.md", "N"), ("src/a.py", "docs/s.md", "S"), ("src/a.py", "docs/t.md", "T"), ("srcx.py", "docs/none.md", "N")]
    assert sorted((r.spec_id, r.linked_path, r.code_indexed_at) for r in S.stale_specs(files, specs, links).collect()) == [(1, "src/", 50), (1, "src/", 60)]
    assert S.specs_for_files(files, specs, links.limit(0)).count() == 0


def _moved(spark):
    """Rows written to shuffles by each stage so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}


@pytest.fixture
def no_broadcast(spark):
    """Joins as large tables have them."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def _project_files(spark, folder):
    """Two projects of 100 specifications each and 200 files in folders that both have; a project with files only; returns the folder."""
    rows = [(i, f"p{i % 2}", f"docs/{i}.md") for i in range(200)] + [(200 + i, f"p{i % 2}", f"src/{'ab'[i // 2 % 2]}/{i}.py") for i in range(200)]
    rows += [(400, "p0", "src/0.py"), (401, "p1", "src/1.py"), (402, "p2", "lib/2.py"), (403, "p2", None)]
    df = spark.createDataFrame(rows, "file_id long, project string, path string")
    extra = {"language": "string", "hash": "string", "indexed_at": "long", "mtime": "long", "stale": "boolean"}
    df.withColumns({c: F.lit(None).cast(t) for c, t in extra.items()}).write.parquet(f"{folder}/files.parquet")
    return str(folder)


def test_specs_for_files_makes_pairs_in_its_last_join(spark, no_broadcast, tmp_path, monkeypatch):
    """The pairs are neither moved nor compared, however many tasks make them."""
    d = _project_files(spark, tmp_path)
    monkeypatch.setattr(S, "TASK_ROWS", 3_000, raising=False)
    before = _moved(spark)
    got = reads.join_specs_for_files(spark, d).collect()
    assert len(got) == len(set(got)) == 202 * 200
    assert sum(n for stage, n in _moved(spark).items() if stage not in before) < 20_000


def test_specs_for_files_names_each_pair_once(spark):
    files = spark.createDataFrame([("a/b/x",), ("a/b/x",), ("a/y",), ("é/𝒜z",), ("z",), (None,)], "path string")
    specs = spark.createDataFrame([(1, "p", "T"), (2, "p", "T"), (3, "p", None), (4, "q", "T"), (None, "r", "T"), (5, "w", "W")], "spec_id int, path string, title string")
    links = spark.createDataFrame([(1, "a/"), (1, "a/b/"), (2, "a/b/x"), (2, "z"), (3, "a/b/"), (3, "a/b/x"), (4, "é/𝒜"), (5, ""), (5, "a/"), (None, "a/"), (9, "a/")], "spec_id int, linked_path string")
    assert sorted(map(tuple, S.specs_for_files(files, specs, links).collect()), key=str) == sorted([
        ("a/b/x", "p", "T"), ("a/y", "p", "T"), ("z", "p", "T"), ("a/b/x", "p", None), ("é/𝒜z", "q", "T"), *((x, "w", "W") for x in ("a/b/x", "a/y", "é/𝒜z", "z"))], key=str)


def test_annotate_specs_makes_each_list_once(spark, no_broadcast, tmp_path, monkeypatch):
    """No pair of a file and a specification is moved; every list is whole, in order, and null where nothing governs."""
    d = _project_files(spark, tmp_path)
    monkeypatch.setattr(S, "TASK_CHARS", 20_000, raising=False)
    before = _moved(spark)
    got = {r.file_id: r.governing_specs for r in reads.annotate_specs(spark, d).collect()}
    every = "|".join(sorted(f"docs/{i}.md" for i in range(200)))
    assert got == {i: every if 200 <= i < 402 else None for i in range(404)}
    assert sum(n for stage, n in _moved(spark).items() if stage not in before) < 20_000


def test_governing_specs_by_nested_links(spark):
    files = spark.createDataFrame([(1, "a/b/x"), (2, "a/b/x"), (3, "a/y"), (4, "z"), (5, None), (6, "b")], "file_id int, path string")
    specs = spark.createDataFrame([(1, "p"), (2, "p"), (3, "o"), (4, None), (5, "q")], "spec_id int, path string")
    links = spark.createDataFrame([(1, "a/"), (2, "a/b/"), (3, "a/b/"), (4, "z"), (5, "a/y"), (9, "a/"), (1, None)], "spec_id int, linked_path string")
    got = {r.file_id: r.governing_specs for r in S.governing_specs(files, specs, links).collect()}
    assert got == {1: "o|p", 2: "o|p", 3: "p|q", 4: None, 5: None, 6: None}
    assert {r.governing_specs for r in S.governing_specs(files, specs, links.limit(0)).collect()} == {None}


@pytest.mark.parametrize("per_round", [2, 3, 100])
def test_harvest_in_order(spark, per_round):
    stored = spark.createDataFrame([("s", [0.0, 1.0])], "id string, embedding array<double>")
    rows = [("a", [1.0, 0.0], "x"), ("b", [1.0, 0.01], "y"), ("c", [0.0, 0.99], "z"), ("d", [5.0, 0.0], "x"), ("e", [5.0, 0.01], "w"), ("f", [9.0, 0.0], None), ("g", [12.0, 0.0], None), ("h", [20.0, 0.0], "old")]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, source_ref string")
    known = spark.createDataFrame([("old",)], "source_ref string")
    got = {r.id: r.verdict for r in H.harvested(df, stored, known, 0.1, "id", per_round).collect()}
    assert got == {"a": "stored", "b": "similar", "c": "similar", "d": "harvested", "e": "stored", "f": "stored", "g": "stored", "h": "harvested"}


def test_remote_notes(spark):
    stored = spark.createDataFrame([(1, "r1", "e1"), (2, None, "e2"), (3, None, None)], "id long, remote_id string, entity_id string")
    remote = spark.createDataFrame([("r1", "zz", False, 1), ("r1", "zz", True, 2), ("r2", "e2", None, 1), ("r3", "e3", False, 5), ("r4", "e3", True, 4), (None, "e9", False, 1)],
                                   "remote_id string, entity_id string, archived boolean, at long")
    assert sorted(map(tuple, N.apply_remote(stored, remote).collect())) == [
        ("r1", "zz", "known", 1, True), ("r2", "e2", "linked", 2, False), ("r3", "e3", "linked", None, False), ("r4", "e3", "created", None, True)]


def test_collapse_and_idempotent_insert(spark):
    rows = [(1, "a", "active", 5, None, ["x"], None), (2, "a", "archived", 3, 9, ["y", "x"], ["f"]), (3, "b", "archived", 1, 1, None, None), (4, "c", "archived", 1, 4, [], [" "])]
    df = spark.createDataFrame(rows, "id long, entity string, status string, created_at long, superseded_by long, tags array<string>, linked_files array<string>")
    got = {r.entity: r for r in N.collapse(df, "entity").collect()}
    assert (got["a"].archived, got["a"].created_at, got["a"].rows, got["a"].tags, got["a"].unresolved, got["a"].superseded_by_entity) == (True, 3, 2, ["y", "x"], True, None)
    assert (got["b"].superseded_by_entity, got["b"].unresolved, got["c"].superseded_by_entity, got["c"].unresolved) == ("a", False, None, False)
    out = {r.entity: (r.id, r.created, sorted(r.tags or [])) for r in N.insert_idempotent(df.where("id > 1"), df.where("id = 1").union(df.where("id = 1").withColumn("id", F.lit(8)).withColumn("entity", F.lit("n"))), "entity").collect()}
    assert out["a"] == (2, False, ["x", "y"]) and out["n"] == (8, True, ["x"])


def test_context_by_kind_and_budget(spark):
    rows = [(1, "question", "q" * 40, "", 9), (2, "decision", "d" * 40, "", 1), (3, "decision", "d" * 400, "", 5), (4, "handoff", "h" * 40, None, 3), (5, "other", "o" * 40, "", 4)]
    notes = spark.createDataFrame(rows, "id long, kind string, title string, body string, created_at long")
    rules = spark.createDataFrame([("naming", "snake case in all")], "category string, description string")
    pack = lambda b: [(r.source, r.ref) for r in R.context_pack(notes, rules, b, {"decision": 10}, 20).collect()]
    assert pack(1000) == [("note", "3"), ("note", "2"), ("note", "4"), ("note", "1"), ("note", "5"), ("convention", "snake case in all")]
    assert pack(22) == [("note", "2"), ("note", "4")]  # the long decision is skipped


def test_vectors_of_another_index_fail_the_job(spark):
    ok = spark.createDataFrame([("m", [1.0, 2.0]), (None, [0.0, 1.0])], "model string, embedding array<float>")
    assert N.require_provenance(ok, "m", 2).count() == 2
    for bad in (("m", [1.0]), ("n", [1.0, 2.0])):
        with pytest.raises(Exception, match="vectors of another index"):
            N.require_provenance(ok.union(spark.createDataFrame([bad], ok.schema)), "m", 2).collect()


def test_where_an_automatic_search_goes(spark, tmp_path):
    from cairnset.engine import Engine
    from cairnset.operators import live as L

    assert [L.rung(0, 0, True), L.rung(5, 0, True), L.rung(5, 5, False), L.rung(5, 2, True)] == ["live", "live", "live", "index"]
    assert [L.next_rung(1, 5, 2, True), L.next_rung(0, 5, 2, True), L.next_rung(0, 5, 5, True), L.next_rung(0, 5, 5, False)] == ["done", "text", "live", "done"]
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def load_lease(x):\n    return Stale_Cache(x)\n")
    e = Engine(spark, str(tmp_path / "store"))
    where, hits = e.find("stale_cache", root=str(src))
    assert where == "live" and [(r.path, r.line_no) for r in hits.collect()] == [("a.py", 2)]
    e.index(str(src))
    assert [r.name for r in e.search("lease").collect()] == ["load_lease"]
    assert {tuple(r) for r in e.table("edges").where("kind = 'calls'").select("source_name", "target_name").collect()} == {("load_lease", "Stale_Cache")}
    e.save("vectors", spark.createDataFrame([(e.table("chunks").first().chunk_id, [1.0, 0.0])], "chunk_id string, embedding array<float>"))
    where, hits = e.find("stale", [1.0, 0.0], root=str(src))
    assert where == "index" and hits.count() == 1
    assert [(r.line_no, r.kind) for r in L.graph_live(spark.createDataFrame([("p", "x\nrun(1)\nrunner(2) run (3)")], "path string, text string"), "run").collect()] == [(1, "calls"), (2, "calls")]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_a_rate_over_many_tasks_is_the_rate_in_order(spark, parts):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "cold"]), i, rng.choice([None, rng.random() * 100])) for i in range(400)] + [("one", 1, 7.0), ("two", 2, 1.0), ("two", 5, 2.0), (None, 1, 1.0), ("none", 3, None)]
    want = {}
    for k, _, v in sorted(rows, key=lambda r: r[1]):
        if k and v is not None:
            want[k] = H.blend_rate(want.get(k, (0, 0.0)), v)
    df = spark.createDataFrame(rows, "k string, at long, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.k: r.rate for r in H.moving_rate(df, "k", "at", "v").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k][1]) < 1e-9 for k in want)


def test_exact_medians_of_any_group(spark):
    import random
    import statistics

    from cairnset.functions import metrics as M

    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([None, float("nan"), 1.0, 2.0, rng.random() * 9])) for _ in range(900)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    groups = {}
    for k, v in rows:
        if v is not None and v == v:
            groups.setdefault(k, []).append(v)
    df = spark.createDataFrame(rows, "k string, v double")
    assert {r.k: r.median for r in M.exact_median(df, ["k"], "v").collect()} == {k: statistics.median(v) for k, v in groups.items()}
    got = {r.k: r.median for r in M.exact_median(df, ["k"], "v", held=10).collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}


def test_history_lines_roots_and_sizes(spark):
    from cairnset.sources import export, files

    lines = ['{"sessionId": "a", "project": "/w/x", "timestamp": 5, "display": "two"}', '{"sessionId": "a", "project": "/w/x", "timestamp": 4, "display": "one"}', "{broken", "", None, "[1]", '{"project": "/w"}',
             '{"sessionId": "a", "project": "/v", "timestamp": 9, "display": "no"}', '{"sessionId": "b", "project": "/w", "timestamp": 3, "display": "old"}']
    sessions, errors = export.read_history(spark.createDataFrame([(x,) for x in lines], "value string"), 4, "/w")
    assert [tuple(r) for r in sessions.collect()] == [("a", 2, 4, ["one", "two"])] and errors.first()[0] == 3
    paths = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",), ("a/x",)], "path string")
    roots = spark.createDataFrame([("a/",), ("a/b/",), ("",)], "root string")
    assert {tuple(r) for r in S.nearest_root(paths, roots).collect()} == {("a/b/c", "a/b/"), ("a/x", "a/"), ("z", None)}
    assert [r[0] for r in spark.createDataFrame([(10,), (600 << 10,), (65 << 20,)], "n long").select(files.size_gate(F.col("n"))).collect()] == ["parse", "windows", "skip"]


def test_rounds_of_a_sync(spark):
    local = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "uuid string")
    server = spark.createDataFrame([("b", 1), ("c", 2), ("d", 9), ("d", 3), (None, 9)], "uuid string, at long")
    run = lambda cursor: sorted(map(tuple, N.sync_round(local, server, cursor).collect()))
    assert run(None) == [("pull", "a", False), ("pull", "b", False), ("pull", "c", True), ("pull", "d", True), ("push", "a", False)]
    assert run(F.lit(2)) == [("pull", "d", True), ("pull again", "a", False), ("pull again", "d", False), ("push", "a", False)]
