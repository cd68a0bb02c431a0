"""Parent-child rows to full hierarchies: roots, depths, cycles, paths and descendants.

Links are contracted by weighted disjoint-set forests: every task holds a bucket of links, jumps each node to the
farthest ancestor known inside the bucket and adds up the offsets. Then buckets are merged four to one. Only nodes that
some unfinished chain of another bucket runs into go up the tree of merges; all others wait with their offsets and are
answered from them on the way back, so what is merged shrinks from level to level. Where a merged bucket would still hold
more than `max_task_rows` links, the rest is finished by pointer doubling between tasks, with the same result: no task and
no driver ever needs the whole forest. Paths are then materialised by indexed parent traversal, tree by tree; trees too
large for one task are traversed by doubling joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnset.session import cut, salted_join

OPEN, ROOTED, CYCLIC = 0, 1, 2
#: Buckets that become one in a merge.
FAN = 4
_STATE = "node long, up long, off long, low long, status int"


def parent_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, parent) over links whose two ends are in `nodes(id)`; one row per node.

    Null ends and ends without a node are dropped first, repeated links count once, and of several different parents
    (which the input should not have) the smallest is taken, so the result is always a functional graph.
    """
    ids = nodes.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
    once = links.where("node is not null and parent is not null").distinct()
    known = once.join(ids.withColumnRenamed("id", "node"), "node", "left_semi")
    both = salted_join(known, ids.withColumnRenamed("id", "parent"), "parent")
    return both.groupBy("node").agg(F.min("parent").alias("parent"))


def _contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weighted union-find over one bucket: jump as far as the bucket's own rows reach; finished rows pass their state on."""
    pdf = pdf.sort_values("node", kind="stable")
    node, up, off, low, status = (pdf[c].to_numpy().copy() for c in ("node", "up", "off", "low", "status"))
    n, rows = len(node), np.arange(len(node))
    at = np.minimum(np.searchsorted(node, up), n - 1)
    first = np.where((status == OPEN) & (node[at] == up), at, -1)
    ptr = first.copy()
    for _ in range(int(n).bit_length() + 1):
        live = np.flatnonzero(ptr >= 0)
        if not len(live):
            break
        nxt = ptr[live]
        up[live], off[live], low[live], status[live] = up[nxt], off[live] + off[nxt], np.minimum(low[live], low[nxt]), status[nxt]
        ptr[live] = ptr[nxt]
    looped = np.flatnonzero(ptr >= 0)
    if len(looped):  # after n steps the pointer of such a row stands on its cycle
        least, jump = pdf["low"].to_numpy().copy(), np.where(first >= 0, first, rows)
        for _ in range(int(n).bit_length() + 1):
            least, jump = np.minimum(least, least[jump]), jump[jump]
        up[looped] = least[ptr[looped]]
        status[looped] = CYCLIC
    return pd.DataFrame({"node": node, "up": up, "off": off, "low": low, "status": status})


def forest_roots(links: DataFrame, max_task_rows: int = 1_000_000) -> DataFrame:
    """(node, root, depth, never_ends) for every node of `links(node, parent)` that has a parent. `links` is read twice.

    If the chain runs into a cycle, root is the smallest node on it, depth is null and never_ends is true.
    """
    state = links.select(
        "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("off"), F.col("node").alias("low"),
        F.lit(OPEN).alias("status"))
    total, buckets, waiting = links.count(), FAN, []
    while buckets * max_task_rows < FAN * total:
        buckets *= FAN
    while True:
        key = F.pmod(F.xxhash64("node"), F.lit(buckets)).alias("bucket")
        state = cut(state.groupBy(key).applyInPandas(_contract, _STATE))
        if buckets == 1:
            break
        wanted = state.where(F.col("status") == OPEN).select(F.col("up").alias("node")).distinct().withColumn("wanted", F.lit(True))
        marked = cut(state.join(wanted, "node", "left"))
        waiting.append(marked.where("wanted is null").drop("wanted"))
        state, buckets = marked.where("wanted").drop("wanted"), buckets // FAN
        if buckets * max_task_rows < total and state.count() > buckets * max_task_rows:
            state = _double(state)
            break
    for late in reversed(waiting):
        state = _resume(late, state).union(state)
        state = cut(state) if late is not waiting[0] else state
    return state.select(
        "node", F.col("up").alias("root"),
        F.when(F.col("status") != CYCLIC, F.col("off")).alias("depth"),
        (F.col("status") == CYCLIC).alias("never_ends"))


def _resume(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows that waited, carried on from the known state of their ancestor; an ancestor without a row is a root."""
    table = known.select(F.col("node").alias("to"), F.col("up").alias("up2"), F.col("off").alias("off2"),
                         F.col("low").alias("low2"), F.col("status").alias("status2"))
    is_open = F.col("status") == OPEN
    return salted_join(rows.withColumn("to", F.when(is_open, F.col("up"))), table, "to", "left").select(
        "node",
        F.coalesce("up2", "up").alias("up"),
        (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"),
        F.least("low", "low2").alias("low"),
        F.when(is_open, F.coalesce("status2", F.lit(ROOTED))).otherwise(F.col("status")).alias("status"))


def _double(state: DataFrame) -> DataFrame:
    """Finish links that cross buckets: each round joins every unfinished row to the row of its current ancestor."""
    rounds, before = 0, None
    while True:
        state = cut(_resume(state, state))
        rounds += 1
        left = state.where(F.col("status") == OPEN).count()
        if left == 0:
            return state
        # In every round some open row that leads to a root is finished; when none is, only cycles are left.
        if left == before and 2 ** rounds >= left:
            break
        before = left
    rest = state.where(F.col("status") == OPEN)
    on_cycle = rest.select(F.col("up").alias("node")).distinct()
    lows = rest.join(on_cycle, "node", "left_semi").select(F.col("node").alias("up"), F.col("low").alias("least"))
    closed = salted_join(rest, lows, "up").select(
        "node", F.col("least").alias("up"), "off", "low", F.lit(CYCLIC).alias("status"))
    return state.where(F.col("status") != OPEN).union(closed)


def _walk_trees(pdf: pd.DataFrame) -> pd.DataFrame:
    """Paths of whole trees in one bucket: an index from node to row, then parents before children."""
    pdf = pdf.sort_values("depth", kind="stable")
    paths: dict[int, list[int]] = {}
    out = []
    for node, parent in zip(pdf["node"].tolist(), pdf["parent"].tolist()):
        path = [*(paths.get(parent) or [parent]), node]
        paths[node] = path
        out.append(path)
    return pd.DataFrame({"node": pdf["node"].to_numpy(), "path": out})


def forest_paths(links: DataFrame, roots: DataFrame, max_task_rows: int = 200_000) -> DataFrame:
    """(node, path) with the path from the root down to the node, for nodes whose chain ends."""
    rows = cut(links.join(roots.where("not never_ends"), "node"))
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("tree_rows"))
    rows = salted_join(rows, sizes, "root")
    total = rows.count()
    buckets = max(1, -(-total // max_task_rows))
    small = rows.where(F.col("tree_rows") <= max_task_rows)
    key = F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("bucket")
    walked = small.select("root", "node", "parent", "depth").groupBy(key).applyInPandas(
        _walk_trees, "node long, path array<long>")
    large = rows.where(F.col("tree_rows") > max_task_rows)
    deepest = large.agg(F.max("depth")).first()[0]
    if deepest is None:
        return walked
    seg = cut(large.select("node", "root", F.col("parent").alias("jump"), F.array("parent").alias("up_path")))
    for _ in range(int(deepest - 1).bit_length()):
        table = seg.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("up_path").alias("more"))
        seg = cut(salted_join(seg, table, "jump", "left").select(
            "node", "root", F.coalesce("jump2", "jump").alias("jump"),
            F.when(F.col("more").isNull(), F.col("up_path")).otherwise(F.concat("up_path", "more")).alias("up_path")))
    return walked.union(seg.select("node", F.concat(F.reverse("up_path"), F.array("node")).alias("path")))


def cycle_paths(links: DataFrame, roots: DataFrame, max_task_rows: int = 200_000) -> DataFrame:
    """(node, path) for nodes whose chain never ends: every other node above it once, up to the first repeated one, then the node.

    Each cycle is opened above its smallest node, which makes a tree of all that runs into it; what of the cycle then lies
    not on a node's path in that tree is put before it.
    """
    endless = roots.where("never_ends").select("node", F.col("root").alias("least"))
    if endless.isEmpty():
        return endless.select("node", F.array("node").alias("path"))
    within = cut(links.join(endless, "node"))
    opened = within.where("node <> least").select("node", "parent")
    tops = within.where("node = least").select("least", F.col("parent").alias("last"))
    walked = forest_paths(opened, cut(forest_roots(opened, max_task_rows)), max_task_rows)
    paths = cut(walked.union(tops.select(F.col("least").alias("node"), F.array("least").alias("path"))).withColumn("least", F.col("path")[0]))
    loops = tops.join(paths.select(F.col("node").alias("last"), F.col("path").alias("loop")), "last").select("least", "loop")
    shared = F.size(F.array_intersect("path", "loop"))
    return salted_join(paths, loops, "least").select("node", F.concat(F.slice("loop", shared + 1, F.size("loop")), "path").alias("path"))


def all_paths(links: DataFrame, roots: DataFrame, max_task_rows: int = 200_000) -> DataFrame:
    """(node, path) for every node with a parent, whether its chain ends or not."""
    return forest_paths(links, roots, max_task_rows).union(cycle_paths(links, roots, max_task_rows))


def descendants(paths: DataFrame) -> DataFrame:
    """(node, descendant, distance): one row per ancestor of each node, never gathered into one row per ancestor."""
    steps = paths.select(F.col("node").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("pos", "node"))
    return steps.where("pos < n - 1").select("node", "descendant", (F.col("n") - 1 - F.col("pos")).cast("long").alias("distance"))


def supersession_links(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Replaced note -> note that replaced it, from both the notes' own pointer and the supersedes edges."""
    own = notes.select(F.col("id").alias("node"), F.col("superseded_by").alias("parent"))
    kind = F.lower(F.trim(F.regexp_replace("kind", r"(?U)^\s+|\s+$", "")))
    drawn = edges.where(kind == "supersedes").select(F.col("to_id").alias("node"), F.col("from_id").alias("parent"))
    return parent_links(notes.select("id"), own.union(drawn))
