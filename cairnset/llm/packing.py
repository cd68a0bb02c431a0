"""Filling fixed-capacity windows with items: best-fit decreasing with a segment tree over remaining capacities.

Items are dealt over shards by a hash of their id (the number of shards follows the number of items, so a shard stays
one task's work); a task receives its shard sorted by falling size and places each item into the open window with the
least room that still holds it, found in the tree in logarithmic time. Only an item larger than the window is split: into
full windows, which need no search, and a remainder, which is packed like any other item.

Null or empty texts have size 0 and are placed like any item. Ties in size go by id. Nothing is dropped or cut off, but a row
without an id is no item.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 100_000
_OUT = "limit_name string, window_id string, item_id long, piece_no int, start long, size long"


class BestFit:
    """Open windows by remaining room. A leaf of the tree says whether any window has exactly that room."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves = capacity, 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.open: dict[int, list[int]] = {}
        self.windows = 0

    def _mark(self, room: int, present: int) -> None:
        tree, i = self.tree, self.leaves + room
        tree[i] = present
        while i > 1:
            i >>= 1
            now = tree[2 * i] | tree[2 * i + 1]
            if tree[i] == now:
                break
            tree[i] = now

    def _least(self, size: int) -> int | None:
        """The smallest room of at least `size` that an open window has."""
        tree, i = self.tree, self.leaves + size
        if tree[i]:
            return size
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None

    def place(self, size: int) -> int:
        room = self._least(size)
        if room is None:
            window, room = self.windows, self.capacity
            self.windows += 1
        else:
            stack = self.open[room]
            window = stack.pop()
            if not stack:
                self._mark(room, 0)
        left = room - size
        stack = self.open.setdefault(left, [])
        stack.append(window)
        if len(stack) == 1:
            self._mark(left, 1)
        return window


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, fit = None, None
    for b in batches:
        limit, cap, shard, size = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("limit_name", "max_size", "shard", "size"))
        ids = []
        for key in zip(limit, cap, shard, size):
            if key[:3] != at:
                at, fit = key[:3], BestFit(key[1])
            ids.append(f"{key[0]}/s{key[2]}/{fit.place(key[3])}")
        col = lambda c: b.column(b.schema.get_field_index(c))
        yield pa.RecordBatch.from_arrays(
            [col("limit_name"), pa.array(ids, pa.string()), col("item_id"), col("piece_no"), col("start"), col("size")],
            names=["limit_name", "window_id", "item_id", "piece_no", "start", "size"])


def pack(items: DataFrame, limits: list[tuple[str, int]], n_items: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """items(item_id, size) into windows of each (name, capacity): limit_name, window_id, item_id, piece_no, start, size."""
    if any(cap <= 0 for _, cap in limits):
        raise ValueError("capacities must be positive")
    table = F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(int(c)).cast("long").alias("max_size")) for n, c in limits])
    rows = items.where("item_id is not null").select("item_id", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("total"), F.explode(table).alias("l")).select(
        "item_id", "total", "l.limit_name", "l.max_size",
        F.when(F.col("total") > F.col("l.max_size"), F.floor(F.col("total") / F.col("l.max_size"))).otherwise(0).cast("int").alias("full"))
    whole = rows.where("full > 0").select(
        "limit_name", "item_id", "max_size", F.explode(F.expr("sequence(0, full - 1)")).alias("piece_no")).select(
        "limit_name", F.concat_ws("/", "limit_name", F.concat(F.lit("d"), F.col("item_id").cast("string")), F.col("piece_no").cast("string")).alias("window_id"),
        "item_id", "piece_no", (F.col("piece_no") * F.col("max_size")).alias("start"), F.col("max_size").alias("size"))
    shards = max(1, -(-n_items // shard_items))
    rest = rows.withColumn("size", F.col("total") - F.col("full") * F.col("max_size")).where("full = 0 or size > 0").select(
        "limit_name", "max_size", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard"), "item_id",
        F.col("full").alias("piece_no"), (F.col("full") * F.col("max_size")).alias("start"), "size")
    dealt = rest.repartition("limit_name", "shard").sortWithinPartitions("limit_name", "max_size", "shard", F.desc("size"), "item_id")
    return whole.unionByName(dealt.mapInArrow(_pack, _OUT))
