from cairnset.streaming import streams as S


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_since_sees_late_rows_of_the_same_second_once(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, ts timestamp"
    import datetime as d

    t = d.datetime(2025, 1, 1)
    write(spark, path, [(1, t), (2, t), (2, t)], schema)
    stream = lambda: S.since(S.table_stream(spark, path), "id", "ts").select("id")
    assert sorted(r.id for r in S.drain(stream(), folder).collect()) == [1, 2]
    write(spark, path, [(3, t), (2, t)], schema)
    assert sorted(r.id for r in S.drain(stream(), folder).collect()) == [1, 2, 3]


def test_rate_limit_state_lives_across_batches(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, who string, at long"
    run = lambda: {r.id: r.allowed for r in S.drain(S.rate_limited(S.table_stream(spark, path), "who", "at", "id", 10, 2), folder).collect()}
    write(spark, path, [(1, "a", 0), (2, "a", 1)], schema)
    assert run() == {1: True, 2: True}
    write(spark, path, [(3, "a", 5), (4, "a", 10), (5, "b", 3)], schema)
    assert run() == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_relay_buffer_fills_and_acks_free_it(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "project string, item string, action string"
    run = lambda: {(r.item, r.cursor) for r in S.drain(S.relay_buffer(S.table_stream(spark, path), "project", "item", "action", 2), folder).collect()}
    write(spark, path, [("p", i, "pull") for i in ("c", "a", "b", "a")], schema)
    assert run() == {("a", "b"), ("b", "b")}
    write(spark, path, [("p", "a", "ack"), ("p", "c", "pull"), ("p", "b", "pull")], schema)
    assert run() == {("a", "b"), ("b", "b"), ("c", "c")}


def test_windowed_counts_give_out_every_closed_day(spark, tmp_path):
    import datetime as d

    from cairnset.plans import catalogue

    at = [d.datetime(2024, 1, 18, 5), d.datetime(2024, 1, 19, 5), d.datetime(2024, 1, 25, 5), d.datetime(2024, 1, 25, 6), d.datetime(2024, 1, 30, 2)]
    rows = spark.createDataFrame([(i, i, "x", t) for i, t in enumerate(at)], "event_id long, user_id long, event_type string, ts timestamp_ntz")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.day, r.n) for r in catalogue.QUERIES["stm_windowed_counts"](spark, str(tmp_path)).collect()}
    assert got == {("2024-01-18", 1), ("2024-01-19", 1), ("2024-01-25", 2)}


def test_relay_lets_every_item_in_whatever_the_capacity(spark, tmp_path):
    rows = [(p, f"{i:03d}") for p in ("a", "b") for i in range(3 if p == "a" else 8)] + [("a", "001"), ("a", None)]
    pulled = spark.createDataFrame(rows, "project string, item string")
    got = sorted((r.project, r.item, r.cursor) for r in S.relay_drained(pulled, "project", "item", 3, str(tmp_path / "three")).collect())
    assert got == [("a", f"{i:03d}", "002") for i in range(3)] + [("b", f"{i:03d}", f"{min(7, i // 3 * 3 + 2):03d}") for i in range(8)]
    assert S.relay_drained(pulled.limit(0), "project", "item", 3, str(tmp_path / "none")).count() == 0


def test_relay_query_takes_ids_in_every_notation(spark, tmp_path):
    from cairnset.plans import catalogue

    plain = [f"00000000-0000-4000-8000-{i:012x}" for i in range(60)]
    written = [*plain[:56], "urn:uuid:" + plain[56], "{" + plain[57].upper() + "}", plain[58].replace("-", ""), f"  {plain[59]} ", plain[0].upper(), "", None]
    spark.createDataFrame([("p", x) for x in written], "project string, remote_id string").write.parquet(str(tmp_path / "relay_pulled.parquet"))
    got = catalogue.QUERIES["stm_relay"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("p", i, plain[59]) for i in plain]
