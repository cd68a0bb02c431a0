"""Streams: new rows since a checkpoint, stateful rate limits, per-session relay buffers.

Sinks and checkpoints lie in the shared checkpoint folder of the session, so a restarted driver or executor resumes.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnset.operators.notes import _admit
from cairnset.session import cut, ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/streams/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table (file or folder) as a stream of its files."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    if os.path.isfile(os.path.realpath(path)):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now into a parquet sink, exactly once per row, and read the sink.

    Draining the same folder again continues from its checkpoint: only rows that came since are added.
    """
    q = stream.writeStream.format("parquet").option("path", folder + "/rows").option("checkpointLocation", folder + "/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder + "/rows")


def since(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Rows as they come, each id once; a repeat is recognised up to `late` after the first (state is dropped then)."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def rate_limited(stream: DataFrame, principal: str, at: str, key: str, window: int, most: int) -> DataFrame:
    """Fixed windows opening at a principal's first request, kept as state across batches."""
    kind = stream.schema[principal].dataType.simpleString()

    def step(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(frames)).sort_values([at, key])
        allowed, start, used = _admit(pdf[at].tolist(), start, used, window, most)
        state.update((start, used))
        yield pd.DataFrame({key: pdf[key].to_numpy(), principal: who[0], "allowed": allowed})

    return stream.groupBy(principal).applyInPandasWithState(
        step, f"{key} long, {principal} {kind}, allowed boolean", "start long, used long", "append", GroupStateTimeout.NoTimeout)


def relay_buffer(stream: DataFrame, session: str, item: str, action: str, capacity: int) -> DataFrame:
    """Per session a buffer of items by id: pulls enter in id order until it is full and move the cursor, acks remove.

    Emits (session, item, cursor) for what enters; an item already held or before the cursor's end enters once.
    """

    def step(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, cursor = (set(json.loads(state.get[0])), state.get[1]) if state.exists else (set(), None)
        pdf = pd.concat(list(frames))
        held -= set(pdf[pdf[action] == "ack"][item])
        entered = []
        for i in sorted(set(pdf[pdf[action] == "pull"][item].dropna())):
            if i not in held:
                if len(held) >= capacity:
                    break
                held.add(i)
                entered.append(i)
            cursor = i if cursor is None or i > cursor else cursor
        state.update((json.dumps(sorted(held)), cursor))
        yield pd.DataFrame({session: [who[0]] * len(entered), item: entered, "cursor": [cursor] * len(entered)})

    return stream.groupBy(session).applyInPandasWithState(
        step, f"{session} string, {item} string, cursor string", "held string, cursor string", "append", GroupStateTimeout.NoTimeout)


def relay_drained(pulled: DataFrame, session: str, item: str, capacity: int, folder: str) -> DataFrame:
    """Every item through its session's buffer, however many there are: (session, item, cursor) of what entered.

    What a full buffer refuses is offered again: each round pulls the next `capacity` ids after the cursor and acks those
    of the round before, until none is left. The rounds are appended to a folder that the buffers read as a stream.
    """
    order = W.partitionBy(session).orderBy(item)
    ids = pulled.where(F.col(item).isNotNull()).select(session, item).distinct()
    pages = cut(ids.withColumn("page", F.floor((F.row_number().over(order) - 1) / capacity)))
    last = pages.agg(F.max("page")).first()[0]
    for page in range((last or 0) + 1):
        pull = pages.where(F.col("page") == page).select(session, item, F.lit("pull").alias("action"))
        ack = pages.where(F.col("page") == page - 1).select(session, item, F.lit("ack").alias("action"))
        pull.union(ack).write.mode("append").parquet(folder + "/actions")
        entered = drain(relay_buffer(table_stream(pulled.sparkSession, folder + "/actions"), session, item, "action", capacity), folder)
    return entered


def windowed_counts(stream: DataFrame, at: str, width: str, by: str, late: str = "1 hour") -> DataFrame:
    """Rows per window and key; a window is given out once the watermark has passed it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))
