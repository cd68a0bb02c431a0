import pytest
from cairnset.operators import deliveries as D
from pyspark.sql import functions as F

U = "01941f2f-4c48-78b6-a000-00112c15faeb"
FORMS = [U, U.upper(), "{" + U + "}", "urn:uuid:" + U, U.replace("-", ""), f" {U}", f"{U}\n"]


def test_every_notation_is_one_id(spark):
    df = spark.createDataFrame([(x,) for x in [*FORMS, None, "", "  ", "note-7 "]], "v string")
    got = [r[0] for r in df.select(D.message_id(F.col("v"))).collect()]
    assert got == [U] * len(FORMS) + [None, None, None, "note-7"]


def test_first_copy_ties_nulls_and_clashing_columns(spark):
    rows = [("a", 2, "x", 1), ("a", 1, "z", 2), ("a", 1, "y", 3), ("b", None, None, 4), (None, 1, "n", 5), (None, 1, "n", 5)]
    df = spark.createDataFrame(rows, "message_id string, at int, body string, rank int")
    kept = sorted((tuple(r) for r in D.first_deliveries(df, "message_id", "at", ["body"]).collect()), key=str)
    assert kept == sorted([("a", 1, "y", 3), ("b", None, None, 4), (None, 1, "n", 5), (None, 1, "n", 5)], key=str)
    clash = df.withColumnRenamed("rank", "delivery_no")
    assert D.first_deliveries(clash, "message_id", "at", ["body"]).columns == clash.columns
    with pytest.raises(ValueError):
        D.ranked_deliveries(clash, ["message_id"], "at", ["body"])


def test_new_batch_against_stored(spark):
    batch = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), (None, 3)], "message_id string, at int")
    stored = spark.createDataFrame([("a",), ("a",)], "message_id string")
    got = sorted((tuple(r) for r in D.new_messages(batch, stored, "message_id", "at", []).collect()), key=str)
    assert got == [("b", 1), (None, 3)]
    assert D.new_messages(batch.limit(0), stored, "message_id", "at", []).count() == 0


def test_instants(spark):
    df = spark.createDataFrame([("1735692287",), ("1735692287000",), ("2025-01-01T00:00:01Z",), ("2025-01-01T02:00:01.5+02:00",), ("soon",), (None,)], "v string")
    assert [r[0] for r in df.select(D.instant_seconds(F.col("v"))).collect()] == [1735692287, 1735692287, 1735689601, 1735689601, None, None]
