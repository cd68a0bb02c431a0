"""Search without an index: the lines of texts as they are now, and when to fall back on them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matching_lines(texts: DataFrame, pattern: str, key: str = "path", text: str = "text", limit: int | None = None) -> DataFrame:
    """key, line_no (from 1), line of every line that matches; texts without a match are never taken apart."""
    rows = texts.where(F.col(text).rlike(pattern)).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    hits = rows.where(F.col("line").rlike(pattern)).select(key, (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    return hits if limit is None else hits.orderBy(key, "line_no").limit(limit)


def literal(text: str) -> str:
    """A pattern for a text as it stands, without regard to case."""
    return "(?iu)" + re.escape(text)


def call_of(name: str) -> str:
    """A pattern for a call; `$NAME` and `$$$` stand for any name and any arguments."""
    return r"\b" + re.sub(r"\\\$[A-Z_]+", r"\\w+", re.escape(name.removesuffix("($$$)"))) + r"\s*\("


def graph_live(texts: DataFrame, symbol: str, key: str = "path", limit: int = 1000) -> DataFrame:
    """Calls of one symbol as edges, lines from 0."""
    hits = matching_lines(texts, call_of(symbol), key)
    return hits.select(key, (F.col("line_no") - 1).alias("line_no"), F.lit("calls").alias("kind")).orderBy(key, "line_no").limit(limit)


def rung(chunks: int, embedded: int, has_vector: bool) -> str:
    """Where an automatic search starts: `live` without an index, without any embedded chunk or without a query vector, else `index`."""
    return "index" if chunks and embedded and has_vector else "live"


def next_rung(hits: int, chunks: int, embedded: int, stale: bool) -> str:
    """Where it goes on after a search of the index: `text` if nothing was found and the index is embedded in part, `live` if it is stale, else nowhere."""
    return "done" if hits else "text" if embedded < chunks else "live" if stale else "done"
