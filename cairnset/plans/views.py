"""The test tables as the engine's own relations (files, chunks, notes, note edges), in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnset.functions import text as T
from cairnset.session import table

NAME_PATTERN = r"(?:fn|def|func|function|class|struct|interface|impl|trait|enum)\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)"


def files(spark: SparkSession, d: str) -> DataFrame:
    """One row per file_id: the state that is not stale, then the latest."""
    order = W.partitionBy("file_id").orderBy("stale", F.desc("mtime"), F.desc("indexed_at"), "path")
    one = table(spark, d, "files").withColumn("rn", F.row_number().over(order)).where("rn = 1")
    path = F.regexp_replace(T.normalize_path(F.col("path")), r"^(\./)+", "")
    return one.select("file_id", "project", path.alias("path"), "language", "hash", "indexed_at", "mtime")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk once, with the name of what it defines (null where it defines nothing)."""
    c = table(spark, d, "embed_chunks").select("chunk_id", "file_id", "seq", "start_line", "end_line", "node_type", "content", "token_count")
    c = c.dropDuplicates(["chunk_id"])  # rows sent again are identical; columns a query does not use are not shuffled
    return c.withColumn("name", F.nullif(F.regexp_extract("content", NAME_PATTERN, 1), F.lit("")))


def notes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each note once (of all or the named columns, id among them); created_at in seconds, status trimmed and in lower case."""
    if columns:
        columns = tuple(dict.fromkeys((*columns, "id", "created_at", "status")))
    at = F.col("created_at")
    every = table(spark, d, "notes")
    return (every.select(*columns) if columns else every).distinct().withColumns({
        "created_at": F.when(at >= 100_000_000_000, F.floor(at / 1000)).otherwise(at).cast("long"),
        "status": F.lower(F.trim("status"))})


def file_texts(spark: SparkSession, d: str) -> DataFrame:
    """file_id, path, language (by the path) and the text of each file: its chunks in order of seq."""
    part = F.struct("seq", "chunk_id", F.coalesce("content", F.lit("")).alias("content"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.content), "\n")
    texts = chunks(spark, d).where("file_id is not null").groupBy("file_id").agg(text.alias("text"))
    return files(spark, d).select("file_id", "path").join(texts, "file_id").select("file_id", "path", T.lang_detect(F.col("path")).alias("language"), "text")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Note edges with both ends; kind trimmed and in lower case; each triple once, with its earliest created_at."""
    e = table(spark, d, "memory_edges").where("from_id is not null and to_id is not null")
    return e.groupBy("from_id", "to_id", F.lower(F.trim("kind")).alias("kind")).agg(F.min("created_at").alias("created_at"))


SOURCE = r"regexp_replace(regexp_replace(lower(source), '^\s+|\s+$', '', 'g'), '[\s\-]+', '_', 'g')"
FILES = r"""files_v AS (SELECT file_id, project, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path, language, hash, indexed_at, mtime
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY stale, mtime DESC, indexed_at DESC, path) AS rn FROM files) WHERE rn = 1)"""
CHUNKS = rf"""chunks_v AS (SELECT *, nullif(regexp_extract(content, '{NAME_PATTERN}', 1), '') AS name FROM (
  SELECT DISTINCT chunk_id, file_id, seq, start_line, end_line, node_type, content, token_count FROM embed_chunks))"""
TEXTS = """texts_v AS (SELECT f.file_id, f.path, t.text FROM files_v f JOIN (
  SELECT file_id, string_agg(coalesce(content, ''), chr(10) ORDER BY seq, chunk_id) AS text FROM chunks_v GROUP BY file_id) t USING (file_id))"""
NOTES = """notes_v AS (SELECT DISTINCT id, kind, title, body, tags, linked_files,
  CASE WHEN created_at >= 100000000000 THEN created_at // 1000 ELSE created_at END AS created_at, lower(trim(status)) AS status,
  superseded_by, source_ref, valid_at, invalid_at, uuid, remote_id, entity_id FROM notes)"""
EDGES = """edges_v AS (SELECT from_id, to_id, lower(trim(kind)) AS kind, min(created_at) AS created_at FROM memory_edges
  WHERE from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY from_id, to_id, lower(trim(kind)))"""


def with_views(*views: str, then: str = "") -> str:
    return "WITH " + ",\n".join(views) + "\n" + then
