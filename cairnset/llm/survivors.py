"""Best representative of each duplicate group by skyline selection.

Copies are compared by trust (active before archived), completeness (how many of the offered fields are filled) and
recency (latest instant). The survivor is the lexicographic best of the Pareto-undominated copies; a field it leaves
empty is filled from the next dominance layer that has it, within a layer by the same lexicographic order.

Copies that agree in trust, filled fields and instant stand as one point (the smallest id). A group of up to `GATHER` rows is
layered in one array. A larger one is never gathered: the layer of a point is the longest chain of points above it, which a
scan from the latest instant down finds with one length for each of the twelve pairs of trust and completeness. Each day of
a group is scanned by itself (at most 86,400 instants of 2 * 2**5 points) into a (max, +) matrix of those lengths, the matrices of
its days are multiplied in order, and only the latest point of each trust and set of filled fields is looked up: all others
are dominated by it and offer no further field. Both ways give the layers of all copies.

Null kind, title or body counts as empty; arrays are filled if they hold an element that is neither null nor blank;
other fields if not null and not blank. Rows without an id cannot survive and are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnset.session import cut, salted_join, squeeze

GATHER, BROADCAST_ROWS = 64, 20_000
FIELDS = ["tags", "linked_files", "source_ref", "valid_at", "remote_id"]


def instant(c: Column) -> Column:
    """Epoch seconds; values too large for seconds are milliseconds."""
    return F.when(F.abs(c) >= 100_000_000_000, F.floor(c / 1000)).otherwise(c).cast("long")


def clean_list(c: Column, lower: bool = False) -> Column:
    """Trimmed, without nulls, blanks and repeats, in order; null if nothing is left."""
    word = lambda x: squeeze(x) if lower else F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    kept = F.array_distinct(F.filter(F.transform(c, word), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(kept) > 0, kept)


def filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def copy_key(*texts: Column) -> Column:
    """One key for texts that agree apart from case and white space."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(squeeze(t), F.lit("")) for t in texts]), 256)


def survivors(notes: DataFrame) -> DataFrame:
    """One row per copy group: first_id, last_id, survivor_id, the survivor's fields filled from the layers, layers, candidates."""
    base = notes.where("id is not null").select(
        copy_key(F.col("kind"), F.col("title"), F.col("body")).alias("copy_key"), "id", "kind", "title",
        (squeeze(F.col("status")) == "active").cast("int").alias("t"), squeeze(F.col("status")).alias("status"),
        instant(F.col("created_at")).alias("a"), clean_list(F.col("tags"), lower=True).alias("tags"),
        clean_list(F.col("linked_files")).alias("linked_files"), filled(F.col("source_ref")).alias("source_ref"),
        F.col("valid_at"), filled(F.col("remote_id")).alias("remote_id"))
    mask = sum((F.col(f).isNotNull().cast("int") * (1 << i) for i, f in enumerate(FIELDS)), F.lit(0))
    full = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    base = base.withColumns({"t": F.coalesce("t", F.lit(0)), "mask": mask, "f": full, "a": F.coalesce("a", F.lit(-(2**62)))})
    row = F.struct("t", "f", "a", (-F.col("id")).alias("neg"), "id", "kind", "title", "status", *FIELDS)
    points = base.groupBy("copy_key", "t", "mask", "a").agg(F.max_by(row, -F.col("id")).alias("r"), F.min("id").alias("low"), F.max("id").alias("high"))
    big = cut(base.groupBy("copy_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GATHER).select("copy_key"))
    n_big = big.count()
    if not n_big:
        return _filled(_layered(points))
    part = lambda how: points.join(F.broadcast(big), "copy_key", how) if n_big <= BROADCAST_ROWS else salted_join(points, big, "copy_key", how)
    return _filled(_layered(part("left_anti")).unionByName(_layered_by_days(part("left_semi"))))


def _layered(points: DataFrame) -> DataFrame:
    """copy_key, first_id, last_id, candidates, layers and z: the points of each group, best first, each with its layer and place."""
    groups = points.groupBy("copy_key").agg(
        F.min("low").alias("first_id"), F.max("high").alias("last_id"), F.count(F.lit(1)).alias("candidates"), F.sort_array(F.collect_list("r"), asc=False).alias("c"))
    # lexicographic order puts every copy behind those that dominate it, so one pass finds the layers
    layers = F.expr("""aggregate(c, cast(array() as array<struct<t:int,f:int,a:bigint,layer:int>>), (acc, x) -> concat(acc, array(
        named_struct('t', x.t, 'f', x.f, 'a', x.a, 'layer', 1 + coalesce(array_max(transform(filter(acc,
          y -> y.t >= x.t and y.f >= x.f and y.a >= x.a and (y.t > x.t or y.f > x.f or y.a > x.a)), y -> y.layer)), 0)))))""")
    ranked = groups.withColumn("l", layers).withColumn("z", F.expr("transform(c, (x, i) -> struct(l[i].layer as layer, i as pos, x as r))"))
    return ranked.select("copy_key", "first_id", "last_id", "candidates", F.expr("array_max(transform(l, x -> x.layer))").alias("layers"), "z")


_CLASSES = [(t, f) for t in (1, 0) for f in range(len(FIELDS), -1, -1)]
_NONE = -(1 << 40)
#: For each class the classes no worse, itself included; the last entry starts a chain.
_ABOVE = [[j for j, (u, g) in enumerate(_CLASSES) if u >= t and g >= f] + [len(_CLASSES)] for t, f in _CLASSES]


def _day(pdf: pd.DataFrame) -> pd.DataFrame:
    """One day of a group: how much it lengthens the chains, and that up to the latest point of each trust and mask."""
    full = [bin(m).count("1") for m in pdf["mask"]]
    pdf = pdf.assign(cls=[_CLASSES.index(c) for c in zip(pdf["t"], full)]).sort_values(["a", "cls"], ascending=[False, True], kind="stable")
    size = len(_CLASSES) + 1
    longest = np.full((size, size), _NONE, np.int64)
    np.fill_diagonal(longest, 0)
    out, seen, last = [], set(), None
    for t, mask, a, cls in zip(pdf["t"].tolist(), pdf["mask"].tolist(), pdf["a"].tolist(), pdf["cls"].tolist()):
        if (a, cls) != last:
            longest[cls], last = 1 + longest[_ABOVE[cls]].max(0), (a, cls)
        if (t, mask) not in seen:
            seen.add((t, mask))
            out.append((t, mask, longest[cls].tolist()))
    key, day = pdf["copy_key"].iloc[0], int(pdf["day"].iloc[0])
    return pd.DataFrame([(key, day, *o) for o in [*out, (None, None, longest.ravel().tolist())]], columns=["copy_key", "day", "t", "mask", "chains"])


def _days(pdf: pd.DataFrame) -> pd.DataFrame:
    """The days of a group from the latest down: the layer of the latest point of each trust and mask, and the number of layers."""
    size = len(_CLASSES) + 1
    state = np.full(size, _NONE, np.int64)
    state[-1] = 0
    layer: dict[tuple, int] = {}
    for _, day in pdf.sort_values("day", ascending=False, kind="stable").groupby("day", sort=False):
        steps = day[day["t"].isna()]["chains"].iloc[0]
        for t, mask, chains in day[day["t"].notna()][["t", "mask", "chains"]].itertuples(index=False):
            layer.setdefault((int(t), int(mask)), int((np.asarray(chains) + state).max()))
        state = np.maximum((np.asarray(steps).reshape(size, size) + state).max(1), _NONE)
    rows = [(pdf["copy_key"].iloc[0], t, m, v, int(state[:-1].max())) for (t, m), v in layer.items()]
    return pd.DataFrame(rows, columns=["copy_key", "t", "mask", "layer", "layers"])


def _layered_by_days(points: DataFrame) -> DataFrame:
    """What `_layered` gives, for groups of any size; z holds the latest point of each trust and set of filled fields."""
    day = F.floor(F.col("a") / 86_400).alias("day")
    scanned = points.select("copy_key", day, "t", "mask", "a").groupBy("copy_key", "day").applyInPandas(
        _day, "copy_key string, day long, t int, mask int, chains array<long>")
    layer = scanned.groupBy("copy_key").applyInPandas(_days, "copy_key string, t int, mask int, layer int, layers int")
    latest = points.groupBy("copy_key", "t", "mask").agg(
        F.max_by("r", "a").alias("r"), F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n"))
    z = F.transform(F.sort_array(F.collect_list(F.struct("r", "layer")), asc=False), lambda x, i: F.struct(x.layer.alias("layer"), i.alias("pos"), x.r.alias("r")))
    return latest.join(layer, ["copy_key", "t", "mask"]).groupBy("copy_key").agg(
        F.min("low").alias("first_id"), F.max("high").alias("last_id"), F.sum("n").alias("candidates"), F.max("layers").alias("layers"), z.alias("z"))


def _filled(groups: DataFrame) -> DataFrame:
    best = F.expr("element_at(filter(z, y -> y.layer = 1), 1).r")
    fill = {f: F.expr(f"array_min(transform(filter(z, y -> y.r.{f} is not null), y -> struct(y.layer as layer, y.pos as pos, y.r.{f} as v))).v") for f in FIELDS}
    return groups.withColumn("best", best).select(
        "copy_key", "first_id", "last_id", F.col("best.id").alias("survivor_id"), F.col("best.kind").alias("kind"),
        F.col("best.title").alias("title"), F.col("best.status").alias("status"),
        F.expr("nullif(best.a, -4611686018427387904)").alias("created_at"), *[c.alias(f) for f, c in fill.items()], "layers", "candidates")
