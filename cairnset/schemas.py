"""Schemas of the engine's relations, and reading older stores under them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FILES = "file_id long, path string, language string, hash string, indexed_at long, mtime long"
CHUNKS = ("chunk_id string, file_id long, node_type string, name string, start_line int, end_line int, content string, metadata string, token_count int, graph_rank double, summary string")
EDGES = "source_file string, source_name string, target_name string, kind string, line int"
NOTES = ("id long, kind string, title string, body string, tags array<string>, linked_files array<string>, created_at long, status string, superseded_by long, source_ref string, "
         "valid_at long, invalid_at long, uuid string, remote_id string, entity_id string")
NOTE_EDGES = "from_id long, to_id long, kind string, created_at long"
REQUIRED = {"id", "file_id", "chunk_id", "kind", "title", "from_id", "to_id"}


def columns(ddl: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ", 1)) for part in ddl.split(", ")]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema in its order and types: absent optional ones as nulls, an absent required one is an error."""
    missing = [n for n, _ in columns(ddl) if n not in df.columns and n in REQUIRED]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns(ddl)])
