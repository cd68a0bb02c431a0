"""Streaming queries, harvesting helpers and the remaining operators, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from cairnset.functions import harvest as H
from cairnset.functions import text as T
from cairnset.operators import deliveries as D
from cairnset.plans import views as V
from cairnset.plans.merging import _LIMIT
from cairnset.plans.registry import registry
from cairnset.session import cut, table
from cairnset.streaming import streams as S

QUERIES, ORACLE, query = registry()


def _events(spark, d):
    return S.table_stream(spark, os.path.join(d, "events.parquet"))


@query("SELECT DISTINCT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05'")
def stm_sse(spark, d):
    """New rows by id (not by the second they were written in, which would lose late ones of the same second)."""
    e = _events(spark, d).where(F.col("ts") >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = S.since(e, "event_id", "ts").select("event_id", "user_id", "event_type")
    return S.drain(rows, S.shared_folder(spark, "sse"))


@query("SELECT count(*) AS first_run, 0 AS second_run FROM events")
def stm_watch(spark, d):
    """A consumer that stops and resumes from its checkpoint sees nothing twice."""
    folder, e = S.shared_folder(spark, "watch"), _events(spark, d).select("event_id")
    first = S.drain(e, folder).count()
    again = S.drain(e, folder).count()
    return spark.createDataFrame([(first, again - first)], "first_run long, second_run int")


@query(f"WITH RECURSIVE {_LIMIT} SELECT event_id, user_id, allowed FROM x")
def stm_rate_limit_stream(spark, d):
    """The rate limit as a stateful stream."""
    e = _events(spark, d).select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return S.drain(S.rate_limited(e, "user_id", "at", "event_id", 86_400, 3), S.shared_folder(spark, "limit"))


@query()
def stm_relay(spark, d):
    """Buffers of at most 10,000 items a session, drained until every message has entered."""
    p = table(spark, d, "relay_pulled").select("project", D.message_id(F.col("remote_id")).alias("item"))
    return S.relay_drained(p, "project", "item", 10_000, S.shared_folder(spark, "relay"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events
GROUP BY 1, 2 HAVING min(time_bucket(INTERVAL 1 DAY, ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stm_windowed_counts(spark, d):
    """Daily counts as an event-time stream: every day the watermark has passed."""
    e = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = S.shared_folder(spark, "windows")
    w = S.drain(S.windowed_counts(e, "ts", "1 day", "event_type"), folder)
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


_SUBJECT = "s AS (SELECT doc_id, string_split(text, chr(10))[1] AS subject FROM documents WHERE " + V.SOURCE + " = 'commit_messages')"
_has = lambda words: " OR ".join("contains(x, '" + w.replace("'", "''") + "')" for w in words)


def _subjects(spark, d):
    m = table(spark, d, "documents").where(T.source_name(F.col("source")) == "commit_messages")
    return m.select("doc_id", F.substring_index("text", "\n", 1).alias("subject"))


@query(f"WITH {_SUBJECT} SELECT doc_id, {_has(H.FORMATTERS + H.ROUTINE)} AS routine FROM (SELECT doc_id, lower(trim(subject)) AS x FROM s)")
def fn_routine_subject(spark, d):
    return _subjects(spark, d).select("doc_id", H.routine_subject(F.col("subject")).alias("routine"))


@query(f"WITH {_SUBJECT} SELECT doc_id, starts_with(x, 'revert \"') OR starts_with(x, 'revert: ') OR starts_with(x, 'revert ') OR {_has(H.FAILURES)} AS failure FROM (SELECT doc_id, lower(trim(subject)) AS x FROM s)")
def fn_failure_subject(spark, d):
    return _subjects(spark, d).select("doc_id", H.failure_subject(F.col("subject")).alias("failure"))


@query("SELECT o_orderkey, CAST(least(o_custkey, 250) AS INTEGER) AS n FROM orders")
def fn_range_parse(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("HEAD~"), F.col("o_custkey").cast("string"), F.lit("..HEAD")).alias("r"))
    return o.select("o_orderkey", H.range_count(F.col("r"), F.lit(250)).alias("n"))


@query("""WITH e AS (SELECT user_id, greatest(1, CAST(floor(abs(value)) AS BIGINT)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
c AS (SELECT user_id, rn, sum(t) OVER (PARTITION BY user_id ORDER BY rn) AS s FROM e) SELECT user_id, CAST(greatest(1, count(*) FILTER (s <= 400 AND rn <= 32)) AS INTEGER) AS n FROM c GROUP BY user_id""")
def fn_next_batch_len(spark, d):
    t = H.first_items(table(spark, d, "events"), "user_id", "event_id", F.floor(F.abs("value")).cast("int"), 4 * 8, "t")
    return t.select("user_id", H.next_batch_len(F.col("t"), 0.01, 4.0, 4).alias("n"))


@query()
def fn_llm_batches(spark, d):
    """Commit messages in batches of eight, halved until they fit a context of 4,000."""
    m = table(spark, d, "documents").where(T.source_name(F.col("source")) == "commit_messages")
    return H.model_batches(m, "doc_id", "text", 8, 4_000)


@query()
def fn_extract_json_object(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains("{")).select("doc_id", F.char_length(H.json_object(F.col("text"))).alias("n_chars"))


@query("SELECT doc_id, CASE source WHEN 'source_code' THEN 'search' WHEN 'memory_notes' THEN 'graph' END AS tool, CASE WHEN source IN ('source_code', 'memory_notes') THEN 'q' || doc_id END AS argument FROM documents")
def fn_parse_tool_call(spark, d):
    """Calls of known tools in prose; of an unknown tool nothing comes out."""
    name = F.when(F.col("source") == "source_code", "search").when(F.col("source") == "memory_notes", "graph").otherwise("destroy")
    prose = F.concat(F.lit("I will call: "), F.to_json(F.struct(name.alias("tool"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query"))), F.lit(" then wait."))
    call = cut(table(spark, d, "documents").select("doc_id", H.tool_call(prose).alias("c")))
    return call.select("doc_id", "c.tool", "c.argument")


@query("SELECT event_type AS command, count(*) + 1 AS uses FROM events GROUP BY event_type")
def sink_usage(spark, d):
    """One more use of each command appended to the log."""
    e = table(spark, d, "events").select(F.col("event_type").alias("command"))
    return e.unionByName(e.distinct()).groupBy("command").agg(F.count(F.lit(1)).alias("uses"))


@query("SELECT r_name AS line FROM region")
def sink_text(spark, d):
    """Rows written as text and read back."""
    folder = S.shared_folder(spark, "text")
    table(spark, d, "region").select(F.col("r_name").alias("value")).write.text(folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query("SELECT r_regionkey, r_name FROM region")
def sink_json(spark, d):
    folder = S.shared_folder(spark, "json")
    r = table(spark, d, "region")
    r.write.json(folder)
    return spark.read.schema(r.schema).json(folder)


@query("SELECT count(*) AS files, sum(mtime)::BIGINT AS mtimes FROM files")
def src_sqlite_scan(spark, d):
    """A store read: the scan takes only the columns asked for."""
    return table(spark, d, "files").agg(F.count(F.lit(1)).alias("files"), F.sum("mtime").alias("mtimes"))


@query("SELECT count(DISTINCT id) AS stored FROM notes")
def schema_migrations(spark, d):
    """A store without the newer columns is read under the current schema, the missing ones as nulls."""
    from cairnset.schemas import NOTES, conform

    old = table(spark, d, "notes").drop("entity_id", "uuid", "invalid_at")
    return conform(old, NOTES).agg(F.countDistinct("id").alias("stored"))


@query(r"SELECT count(*) AS with_id FROM relay_pushes WHERE external_id IS NOT NULL AND trim(external_id) <> ''")
def flt_has_id(spark, d):
    return table(spark, d, "relay_pushes").where(D.message_id(F.col("external_id")).isNotNull()).agg(F.count(F.lit(1)).alias("with_id"))
