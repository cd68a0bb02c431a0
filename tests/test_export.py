import hashlib

import pytest

from cairnset.sources import export as X


@pytest.mark.parametrize("size", [7, 600_000])
def test_footer_has_one_definition_at_every_size(spark, size):
    rows = spark.range(2 * size).selectExpr("if(id % 2 = 0, 'note', 'edge') as kind", "lpad(cast(id as string), 8, '0') as ref", "concat('p', id) as payload")
    lone = spark.createDataFrame([("lone", "b", "2"), ("lone", "a", "1"), ("lone", "c", None), (None, "x", "y")], "kind string, ref string, payload string")
    want = {k: (n, hashlib.sha256("".join(hashlib.sha256(x.encode()).hexdigest() for x in of).encode()).hexdigest()) for k, n, of in (
        ("note", size, (f"p{i}" for i in range(0, 2 * size, 2))), ("edge", size, (f"p{i}" for i in range(1, 2 * size, 2))), ("lone", 3, ("1", "2")), (None, 1, ("y",)))}
    assert {r.kind: (r.n, r.digest) for r in X.footer(rows.repartition(5).union(lone)).collect()} == want
    assert X.footer(rows.limit(0)).count() == 0


def test_written_dump_is_verified(spark, tmp_path):
    rows = spark.createDataFrame([("note", "1", "a"), ("edge", "1>2", "b")], "kind string, ref string, payload string")
    assert {(r.kind, r.n, r.verified) for r in X.write_dump(rows, str(tmp_path / "dump")).collect()} == {("note", 1, True), ("edge", 1, True)}
