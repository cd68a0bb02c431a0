import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairnset.functions import text as T
from cairnset.operators import notes as N
from cairnset.operators import retrieval as R

REC = ("entity_id string, schema_version int, kind string, status string, created_at long, id long, source_ref string, remote_id string, superseded_by long, valid_at long, invalid_at long, "
       "tags array<string>, linked_files array<string>, superseded_by_entity_id string")


def record(entity, created, i, **more):
    base = dict(schema_version=1, kind="note", status="active", source_ref=None, remote_id=None, superseded_by=None, valid_at=None, invalid_at=None, tags=["b", "a"], linked_files=[], superseded_by_entity_id=None) | more
    names = [c.strip().split(" ")[0] for c in REC.split(", ")]
    return tuple((base | {"entity_id": entity, "created_at": created, "id": i})[n] for n in names)


COPIES = [record("x", 5, 2, status="archived", valid_at=9, tags=["c"], superseded_by_entity_id="late"), record("x", 5, 1, invalid_at=4, schema_version=2),
          record("x", 3, 9, source_ref="r", superseded_by_entity_id="early", valid_at=7), record("x", 5, 3, superseded_by_entity_id="also", tags=["a"])]


def test_fold_is_the_same_for_every_order_and_idempotent(spark):
    results = set()
    for order in list(itertools.permutations(COPIES))[::3]:
        df = spark.createDataFrame(list(order) + [record("y", 1, 4)], REC)
        results.add(tuple(sorted(map(str, N.fold_records(df).collect()))))
    assert len(results) == 1
    once = N.fold_records(spark.createDataFrame(COPIES, REC))
    assert sorted(map(str, N.fold_records(once).collect())) == sorted(map(str, once.collect()))
    r = once.first()
    assert (r.id, r.created_at, r.status, r.schema_version, r.valid_at, r.invalid_at) == (9, 3, "archived", 2, 7, 4)
    assert r.tags == ["a", "b", "c"] and r.superseded_by_entity_id == "late"  # of the latest copies the smaller key


def test_fold_keeps_the_order_of_a_single_copys_tags_and_needs_all_copies(spark):
    single = N.fold_records(spark.createDataFrame([record("z", 1, 1, tags=["q", "b", "q"])], REC)).first()
    assert single.tags == ["q", "b", "q"]
    # folding in parts loses which copy the pointer came from: the base carries an older created_at
    a, b, c = record("w", 1, 1), record("w", 9, 2, superseded_by_entity_id="new"), record("w", 5, 3, superseded_by_entity_id="old")
    whole = N.fold_records(spark.createDataFrame([a, b, c], REC)).first()
    part = N.fold_records(N.fold_records(spark.createDataFrame([a, b], REC)).unionByName(spark.createDataFrame([c], REC))).first()
    assert whole.superseded_by_entity_id == "new" and part.superseded_by_entity_id == "old"


NOTE = "id long, kind string, title string, body string, tags array<string>, linked_files array<string>, created_at long, status string, superseded_by long, invalid_at long, valid_at long, entity_id string"


def test_dedupe_redirects_pointers_and_unites_lists(spark):
    rows = [(1, "k", "t", "b", ["x", " y "], None, 10, "active", None, None, None, "e1"), (2, "k", "t", "b", ["y", "z", ""], ["f"], 5, "archived", 7, None, None, "e1"),
            (3, "k", "t", "b", None, ["f", "g"], 20, "active", 2, None, None, "e1"), (7, "k", "u", "b", ["p"], None, 1, "active", 3, None, None, "e2"),
            (8, "k", "v", "b", None, None, 1, "active", 1, None, None, None)]
    kept, redirect = N.dedupe_entities(spark.createDataFrame(rows, NOTE))
    got = {r.id: r for r in kept.collect()}
    assert set(got) == {2, 7, 8} and {tuple(r) for r in redirect.collect()} == {(1, 2), (3, 2)}
    assert got[2].tags == ["y", "z", "x"] and got[2].linked_files == ["f", "g"] and got[2].status == "archived" and got[2].superseded_by == 7
    assert got[7].superseded_by == 2 and got[8].superseded_by == 2 and got[8].tags is None


def test_supersede_and_as_of(spark):
    rows = [(1, "k", "t", "b", None, None, 10, "active", None, None, None, "a"), (2, "k", "t", "b", None, None, 10, "archived", None, None, None, "b"), (3, "k", "t", "b", None, None, 10, "active", None, 15, 5, "c")]
    notes, edges = N.supersede(spark.createDataFrame(rows, NOTE), spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "id long, new_id long"), now=20)
    got = {r.id: (r.status, r.superseded_by, r.invalid_at) for r in notes.collect()}
    assert got == {1: ("archived", 9, 20), 2: ("archived", None, None), 3: ("archived", 9, 15)}
    assert {tuple(r) for r in edges.collect()} == {(9, 1, "supersedes", 20), (9, 3, "supersedes", 20)}
    at = lambda t: {r.id for r in R.as_of(notes, t).collect()}
    # archiving alone sets no invalid_at, so note 2 stays visible as of an instant; the window is half open
    assert at(5) == {3} and at(10) == {1, 2, 3} and at(15) == {1, 2} and at(20) == {2} and {r.id for r in R.as_of(notes, None).collect()} == set()


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    new = spark.createDataFrame([(2, "b"), (3, None), (1, None)], "k long, v string")
    assert {tuple(r) for r in N.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, None)}
    assert {tuple(r) for r in N.insert_or_ignore(old, new.union(spark.createDataFrame([(3, "c")], new.schema)), ["k"]).collect()} == {(1, "a"), (2, None), (3, None)}
    assert {tuple(r) for r in N.replace_where(old, new.where("k = 2"), ["k"]).collect()} == {(1, "a"), (2, "b")}
    change = {r.k: r.change for r in N.incremental_diff(old.withColumnRenamed("v", "hash"), new.withColumnRenamed("v", "hash"), ["k"]).collect()}
    assert change == {1: "changed", 2: "changed", 3: "new"}


def test_batches_are_numbered_in_total_order(spark):
    values = list(range(103))
    random.Random(1).shuffle(values)
    got = {r.v: r.batch for r in N.batches(spark.createDataFrame([(v,) for v in values], "v long"), ["v"], 10).collect()}
    assert got == {v: v // 10 for v in values}
    assert N.batches(spark.createDataFrame([], "v long"), ["v"], 10).count() == 0


def test_rate_limit_window_opens_at_the_first_request(spark):
    times = [5, 6, 7, 14, 15, 16, 17, 40]
    df = spark.createDataFrame([("u", t) for t in times] + [(None, 1)], "who string, at long")
    got = {r.at: r.allowed for r in N.rate_limited(df, "who", "at", 10, 2).collect() if r.who}
    assert got == {5: True, 6: True, 7: False, 14: False, 15: True, 16: True, 17: False, 40: True}


def test_entity_id_escapes_like_compact_json(spark):
    import hashlib
    import json

    texts = ['pl"ain', "back\\slash /", "tab\tline\n", "\x01\x1f", "漢é\U0001f469", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.entity_id(F.lit("note"), F.col("t"), F.col("t"))).collect()]
    want = [hashlib.sha256(json.dumps({"body": t, "kind": "note", "title": t}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for t in texts]
    assert got == want


def test_keyset_page_clamps_its_limit(spark):
    df = spark.createDataFrame([(f"{i:04d}",) for i in range(600)], "c string")
    assert N.keyset_page(df, "c", "0009", 3).collect()[0].c == "0010" and N.keyset_page(df, "c", None, 10_000).count() == 500 and N.keyset_page(df, "c", "0001", 0).count() == 1


@pytest.mark.parametrize("text,want", [("2026-03-15", 1773532800), ("2026-03-15T10:00", 1773568800), ("2026-03-15 10:00:05Z", 1773568805), ("15.3.2026", None), ("", None), (None, None)])
def test_parse_as_of(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.parse_as_of(F.col("t"))).first()[0] == want
