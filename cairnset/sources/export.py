"""Logs in, dumps out: JSON lines, commit logs, export records with digests, and their verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = ("schema_version int, id long, kind string, title string, body string, tags array<string>, linked_files array<string>, created_at long, status string, superseded_by long, "
          "source_ref string, valid_at long, invalid_at long, uuid string, remote_id string, entity_id string, superseded_by_entity_id string")


def read_log(lines: DataFrame, newest: int = 1) -> DataFrame:
    """Records of a text log (`value`): blank lines and anything but an object are skipped; a newer schema is an error."""
    objects = lines.where(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())
    parsed = objects.select(F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*")
    version = F.coalesce("schema_version", F.lit(1))
    return parsed.withColumn("schema_version", F.when(version > newest, F.raise_error(F.lit("log was written by a newer version"))).otherwise(version))


def parse_git_log(lines: DataFrame) -> DataFrame:
    """sha, subject, body of entries written as four fields between NUL characters."""
    part = F.split("value", "\u0000")
    return lines.select(part[0].alias("sha"), part[1].alias("subject"), part[2].alias("body"))


def relationships(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends exist, each (kind, from, to) once, the one with a created_at if any has it."""
    one = edges.groupBy("from_id", "to_id", "kind").agg(F.min("created_at").alias("created_at"))
    known = ids.select("id").distinct()
    return one.join(known.toDF("from_id"), "from_id", "left_semi").join(known.toDF("to_id"), "to_id", "left_semi")


def dangling(edges: DataFrame, ids: DataFrame) -> DataFrame:
    known = ids.select("id").distinct()
    lost_from = edges.join(known.toDF("from_id"), "from_id", "left_anti")
    lost_to = edges.join(known.toDF("from_id"), "from_id", "left_semi").join(known.toDF("to_id"), "to_id", "left_anti")
    return lost_from.select(*edges.columns).union(lost_to.select(*edges.columns))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind: one running digest for each, handed out when the next kind begins."""
    done, now, n, sha = [], None, 0, None
    for b in batches:
        for kind, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if sha is None or kind != now:
                if sha is not None:
                    done.append((now, n, sha.hexdigest()))
                now, n, sha = kind, 0, hashlib.sha256()
            n += 1
            sha.update((digest or "").encode())
    if sha is not None:
        done.append((now, n, sha.hexdigest()))
    kinds, counts, digests = zip(*done) if done else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["kind", "n", "digest"])


HISTORY = "sessionId string, project string, timestamp bigint, display string"


def read_history(lines: DataFrame, since: int, project: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of session history to (session, turns, first_at, texts of turns since an instant in projects under a prefix) and one row of broken lines.

    Blank lines are none; a line that is no JSON object, or has no session, is an error and skipped. A session's texts come in the order
    of their time.
    """
    said = lines.where(F.trim("value") != "").select(F.from_json("value", HISTORY).alias("h"))
    good = F.col("h.sessionId").isNotNull()
    errors = said.agg(F.count(F.when(~F.coalesce(good, F.lit(False)), 1)).alias("errors"))
    kept = said.where(good).select("h.*").where((F.col("timestamp") >= since) & F.col("project").startswith(project))
    turn = F.struct("timestamp", "display")
    sessions = kept.groupBy(F.col("sessionId").alias("session")).agg(
        F.count(F.lit(1)).alias("turns"), F.min("timestamp").alias("first_at"), F.transform(F.array_sort(F.collect_list(turn)), lambda x: x.display).alias("texts"))
    return sessions, errors


def footer(records: DataFrame) -> DataFrame:
    """Count and digest of each kind: SHA-256 over the records' own digests in order of their reference, at every size.

    That digest is sequential by its definition: the records of a kind are sorted on disk and pass through one task as a
    stream, which holds nothing but the running hash.
    """
    digests = records.select("kind", "ref", F.sha2("payload", 256).alias("digest"))
    ordered = digests.repartition("kind").sortWithinPartitions("kind", "ref", "digest")
    return ordered.select("kind", "digest").mapInArrow(_chain, "kind string, n long, digest string")


def verify(records: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Number of records, of references used twice and of relationships with an absent end."""
    twice = records.groupBy("kind", "ref").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("records"), F.count(F.when(F.col("n") > 1, 1)).cast("int").alias("duplicates"))
    return twice.crossJoin(dangling(edges, ids).agg(F.count(F.lit(1)).cast("int").alias("dangling")))  # single rows


def inventory(stores: dict[str, DataFrame]) -> DataFrame:
    """Row counts by store."""
    out = None
    for name, df in stores.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("store"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def write_dump(records: DataFrame, path: str) -> DataFrame:
    """Write records as JSON lines with their footer beside them; returns the footer, read back and checked."""
    wanted = footer(records)
    records.write.mode("overwrite").json(path + "/records")
    wanted.write.mode("overwrite").json(path + "/footer")
    back = footer(records.sparkSession.read.schema(records.schema).json(path + "/records"))
    match = back.alias("b").join(wanted.alias("w"), "kind", "full_outer").select("kind", F.col("w.n").alias("n"), F.col("w.digest").alias("digest"), (F.col("b.digest") == F.col("w.digest")).alias("verified"))
    return match


