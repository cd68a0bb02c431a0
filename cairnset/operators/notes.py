"""Note algebra: identity, merging, dedupe, log folding, lifecycle, incremental upkeep. Pure DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnset.functions import text as T
from cairnset.session import salted_join


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key; a non-null new value replaces the old one."""
    o, n = old.alias("o"), new.alias("n")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    return o.join(n, cond, "full_outer").select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What is there stays; of new rows with one key the smallest is added."""
    whole = F.struct(*[F.col(c) for c in new.columns])
    first = new.groupBy(*key).agg(F.min(whole).alias("r")).select("r.*")
    return old.unionByName(first.join(old, key, "left_anti").select(*old.columns))


def provenance(model: Column, dim: Column, own_model: str, own_dim: int) -> Column:
    """ok, adopt (no model known yet) or why vectors may not be mixed into an index of one model and dimension."""
    return F.when(dim != own_dim, "error: dimension").when(model.isNull(), "adopt").when(model != own_model, "error: model").otherwise("ok")


def require_provenance(vectors: DataFrame, own_model: str, own_dim: int) -> DataFrame:
    """vectors(model, embedding) as they are; the job fails at the first that may not be mixed in."""
    verdict = provenance(F.col("model"), F.size("embedding"), own_model, own_dim)
    return vectors.where(F.assert_true(~verdict.startswith("error"), F.concat(F.lit("vectors of another index: "), verdict)).isNull())


def insert_idempotent(stored: DataFrame, new: DataFrame, entity: str = "entity_id") -> DataFrame:
    """entity, id, created, tags, linked_files: a known entity keeps its id and unites its lists with those that come again."""
    rows = stored.select(entity, "id", "tags", "linked_files", F.lit(0).alias("late")).unionByName(new.select(entity, "id", "tags", "linked_files", F.lit(1).alias("late")))
    first = rows.groupBy(entity).agg(F.min(F.struct("late", "id")).alias("f"))
    aged = F.struct("late", "id")
    united = first.join(_united(rows, entity, "tags", aged).withColumnRenamed("id", entity), entity, "left").join(_united(rows, entity, "linked_files", aged).withColumnRenamed("id", entity), entity, "left")
    return united.select(entity, "f.id", (F.col("f.late") == 1).alias("created"), F.col("m_tags").alias("tags"), F.col("m_linked_files").alias("linked_files"))


def apply_remote(stored: DataFrame, remote: DataFrame) -> DataFrame:
    """remote_id, entity_id, action, id, archived for remote(remote_id, entity_id, archived, at): what each remote note does to the store.

    known: a note has the remote id; linked: a note, or an earlier remote row, has the content, and takes the remote id;
    created: it is new. Archived sticks over all copies of a remote id.
    """
    once = remote.where("remote_id is not null").groupBy("remote_id").agg(F.min(F.struct("at", "entity_id")).alias("f"), F.max(F.coalesce("archived", F.lit(False))).alias("archived"))
    rows = once.select("remote_id", "f.entity_id", "f.at", "archived")
    by_remote = stored.where("remote_id is not null").groupBy("remote_id").agg(F.min("id").alias("known_id"))
    by_entity = stored.where("entity_id is not null").groupBy("entity_id").agg(F.min("id").alias("linked_id"))
    one = salted_join(rows.join(by_remote, "remote_id", "left"), by_entity, "entity_id", "left")
    fresh = one.where("known_id is null and linked_id is null").groupBy("entity_id").agg(F.min(F.struct("at", "remote_id")).remote_id.alias("first_remote"))
    all_ = salted_join(one, fresh, "entity_id", "left")
    made = F.col("linked_id").isNull() & (F.col("remote_id") == F.col("first_remote"))
    return all_.select("remote_id", "entity_id", F.when(F.col("known_id").isNotNull(), "known").when(made, "created").otherwise("linked").alias("action"), F.coalesce("known_id", "linked_id").alias("id"), "archived")


def collapse(notes: DataFrame, entity: str = "entity_id") -> DataFrame:
    """One row per entity: archived sticks, the earliest created_at, united lists, rows, and the entity that supersedes it.

    The pointer is that of the earliest archived copy that has one; pointers at notes unknown here give `unresolved`, those at
    the entity itself give none.
    """
    aged = F.struct("created_at", "id")
    plain = notes.groupBy(entity).agg(F.max(F.col("status") == "archived").alias("archived"), F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("rows"),
                                      F.min_by("superseded_by", F.when((F.col("status") == "archived") & F.col("superseded_by").isNotNull(), aged)).alias("pointer"))
    names = notes.select(F.col("id").alias("pointer"), F.col(entity).alias("to_entity"))
    linked = salted_join(plain, names, "pointer", "left")
    lists = lambda f: _united(notes, entity, f, aged).withColumnRenamed("id", entity)
    full = linked.join(lists("tags"), entity, "left").join(lists("linked_files"), entity, "left")
    return full.select(entity, "archived", "created_at", "rows", F.col("m_tags").alias("tags"), F.col("m_linked_files").alias("linked_files"),
                       F.when(F.col("to_entity") != F.col(entity), F.col("to_entity")).alias("superseded_by_entity"), (F.col("pointer").isNotNull() & F.col("to_entity").isNull()).alias("unresolved"))


def sync_round(local: DataFrame, server: DataFrame, cursor: Column | None) -> DataFrame:
    """stage, uuid, fresh of one round between local(uuid) and server(uuid, at); fresh: not in the store before that stage.

    Without a cursor (the first sync) a round pushes, then pulls everything. Later ones pull what came after the cursor, push, and
    pull again from the same cursor as before the round, so nothing that arrived meanwhile is skipped; what was pushed comes
    back then and is known.
    """
    mine = local.where("uuid is not null").select("uuid").distinct()
    theirs = server.where("uuid is not null").groupBy("uuid").agg(F.max("at").alias("at"))
    pushed = mine.join(theirs, "uuid", "left_anti").select("uuid")
    due = (theirs if cursor is None else theirs.where(F.col("at") > cursor)).select("uuid")
    known = mine.withColumn("known", F.lit(True))
    first_pull = due.join(known, "uuid", "left").select("uuid", F.col("known").isNull().alias("fresh"))
    stage = lambda name, rows: rows.select(F.lit(name).alias("stage"), "uuid", "fresh")
    push, back = pushed.withColumn("fresh", F.lit(False)), pushed.withColumn("fresh", F.lit(False))
    if cursor is None:
        return stage("push", push).union(stage("pull", first_pull.union(back)))
    again = due.withColumn("fresh", F.lit(False)).union(back)
    return stage("pull", first_pull).union(stage("push", push)).union(stage("pull again", again))


def reconcile(server: DataFrame, local: DataFrame, entity: str = "entity_id") -> DataFrame:
    """One row of what reading a server's notes into a store does: rows already present, entities to import, copies collapsed, pointers linked and unresolved.

    `local` holds the entities of the store. Only archived imports bring a pointer; one at the entity itself is skipped.
    """
    known = local.select(entity).where(F.col(entity).isNotNull()).distinct().withColumn("present", F.lit(True))
    c = collapse(server, entity).join(known, entity, "left").withColumn("present", F.coalesce("present", F.lit(False)))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    new = ~F.col("present")
    return c.agg(
        total(F.when(F.col("present"), F.col("rows"))).alias("already_present"), F.count(F.when(new, 1)).alias("to_import"), total(F.col("rows") - 1).alias("collapsed"),
        F.count(F.when(new & F.col("superseded_by_entity").isNotNull(), 1)).alias("linked"), F.count(F.when(new & F.col("unresolved"), 1)).alias("unresolved"))


def replace_where(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Delete then insert: old rows whose key comes again are dropped, all new rows enter."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def dedupe_entities(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes after merging each entity, id -> survivor map of the merged ones).

    The survivor is the earliest copy; tags and files are united in the order of the copies, archived sticks, the pointer is
    the first of the group that does not come to point at the survivor itself; every other row's pointer is redirected.
    """
    known = notes.where("entity_id is not null")
    groups = known.groupBy("entity_id").agg(F.min(F.struct("created_at", "id")).alias("first"), F.count(F.lit(1)).alias("copies"))
    heads = groups.where("copies > 1").select("entity_id", F.col("first.id").alias("survivor"))
    member = salted_join(known.select("id", "entity_id"), heads, "entity_id")
    redirect = member.where("id <> survivor").select("id", "survivor")
    moved = redirect.select(F.col("id").alias("superseded_by"), F.col("survivor").alias("to"))
    pointed = salted_join(notes, moved, "superseded_by", "left").withColumn("pointer", F.coalesce("to", "superseded_by")).drop("to")
    one = salted_join(pointed, heads, "entity_id", "left")
    alone = one.where("survivor is null").select(*[F.col("pointer").alias(c) if c == "superseded_by" else F.col(c) for c in notes.columns])
    group = one.where("survivor is not null")
    aged = F.struct("created_at", "id")
    # every aggregate combines before the shuffle: a group of any size arrives as a few values
    plain = group.groupBy(F.col("survivor").alias("id")).agg(
        F.max(F.col("status") == "archived").alias("m_archived"),
        F.min_by("pointer", F.when(F.col("pointer").isNotNull() & (F.col("pointer") != F.col("survivor")), aged)).alias("m_pointer"))
    base = notes.join(plain, "id").join(_united(group, "survivor", "tags", aged), "id", "left").join(_united(group, "survivor", "linked_files", aged), "id", "left")
    empty = F.array().cast("array<string>")
    new = {"tags": F.coalesce("m_tags", empty), "linked_files": F.coalesce("m_linked_files", empty), "superseded_by": F.col("m_pointer"),
           "status": F.when(F.col("m_archived"), "archived").otherwise(F.col("status"))}
    kept = base.select(*[new.get(c, F.col(c)).alias(c) for c in notes.columns])
    return alone.unionByName(kept), redirect


def _united(rows: DataFrame, by: str, field: str, order: Column) -> DataFrame:
    """id, m_<field>: the distinct trimmed values of a list over all rows of a group, in order of their first appearance."""
    each = rows.select(F.col(by).alias("id"), order.alias("o"), F.posexplode(field).alias("pos", "value")).withColumn("value", F.trim("value")).where("value <> ''")
    first = each.groupBy("id", "value").agg(F.min(F.struct("o", "pos")).alias("at"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x.value).alias(f"m_{field}"))


def fold_records(records: DataFrame, entity: str = "entity_id") -> DataFrame:
    """One record per entity of an append-only log of copies; the same for every order of the copies.

    Base: the smallest (created_at, id, source_ref, remote_id, superseded_by), nulls first. Archived wins, schema_version is the
    largest, valid_at and invalid_at the earliest present, lists are sorted unions where there are two or more copies, and
    superseded_by_entity_id is that of the latest copy that has one. Needs all copies at once: it does not fold in parts.
    """
    key = F.struct("created_at", "id", "source_ref", "remote_id", "superseded_by")
    pick = F.struct((-F.col("created_at")).alias("late"), key.alias("key"), F.col("superseded_by_entity_id").alias("value"))
    folded = records.groupBy(entity).agg(
        F.min_by(F.struct(*[c for c in records.columns if c != entity]), key).alias("base"), F.count(F.lit(1)).alias("copies"),
        F.max(F.col("status") == "archived").alias("any_archived"), F.max("schema_version").alias("max_version"), F.min("valid_at").alias("first_valid"),
        F.min("invalid_at").alias("first_invalid"), F.min(F.when(F.col("superseded_by_entity_id").isNotNull(), pick)).alias("pick"))
    for c in ("tags", "linked_files"):  # distinct values are found before they are gathered
        values = records.select(entity, F.explode(c).alias("v")).distinct().groupBy(entity).agg(F.array_sort(F.collect_list("v")).alias(f"all_{c}"))
        folded = folded.join(values, entity, "left")
    several, empty = F.col("copies") > 1, F.array().cast("array<string>")
    union = lambda c: F.when(several, F.coalesce(f"all_{c}", empty)).otherwise(F.col(f"base.{c}"))
    new = {"status": F.when(F.col("any_archived"), "archived").otherwise(F.col("base.status")), "schema_version": F.col("max_version"), "valid_at": F.col("first_valid"),
           "invalid_at": F.col("first_invalid"), "superseded_by_entity_id": F.col("pick.value"), "tags": union("tags"), "linked_files": union("linked_files")}
    return folded.select(entity, *[new.get(c, F.col(f"base.{c}")).alias(c) for c in records.columns if c != entity])


def anchor_commits(records: DataFrame, entity: str = "entity_id") -> DataFrame:
    """The commit on which each entity's base copy sits."""
    return records.groupBy(entity).agg(F.min_by("commit", F.struct("created_at", "id", "source_ref", "remote_id", "superseded_by")).alias("commit"))


def supersede(notes: DataFrame, mapping: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """mapping(id, new_id): active notes become archived and point at their successor; (notes, new edges)."""
    one = mapping.groupBy("id").agg(F.min("new_id").alias("new_id"))
    hit = notes.join(one, "id", "left")
    on = F.col("new_id").isNotNull() & (F.col("status") == "active")
    new = {"status": F.when(on, "archived").otherwise(F.col("status")), "superseded_by": F.when(on, F.col("new_id")).otherwise(F.col("superseded_by")),
           "invalid_at": F.when(on, F.coalesce("invalid_at", F.lit(now))).otherwise(F.col("invalid_at"))}
    edges = hit.where(on).select(F.col("new_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("supersedes").alias("kind"), F.lit(now).cast("long").alias("created_at"))
    return hit.select(*[new.get(c, F.col(c)).alias(c) for c in notes.columns]), edges


def incremental_diff(indexed: DataFrame, current: DataFrame, key: list[str], content: str = "hash") -> DataFrame:
    """new, changed, removed or unchanged for every key of either side."""
    o = indexed.select(*key, F.col(content).alias("__old"), F.lit(1).alias("__o"))
    n = current.select(*key, F.col(content).alias("__new"), F.lit(1).alias("__n"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("changed")
    return both.select(*key, change.alias("change"))


def keyset_page(rows: DataFrame, cursor: str, after: str | int | None, limit: int) -> DataFrame:
    """The next rows strictly after a cursor, in its order; limit within 1 to 500."""
    page = rows if after is None else rows.where(F.col(cursor) > F.lit(after))
    return page.orderBy(cursor).limit(max(1, min(500, limit)))


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """`batch` number of each row in a total order, `size` rows to a batch, without gathering all rows in one task.

    Rows are range-partitioned; each partition's start is the running sum of the partition sizes before it (one small row
    per partition).
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    from cairnset.session import cut

    spread = cut(spread)
    sizes = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.withColumn("__start", F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))).select("__p", F.coalesce("__start", F.lit(0)).alias("__start"))
    place = F.row_number().over(W.partitionBy("__p").orderBy(*order)) + F.col("__start")
    return spread.join(F.broadcast(starts), "__p").withColumn("batch", F.floor((place - 1) / size).cast("long")).drop("__p", "__start")


def _admit(times: list[int], start: int | None, count: int, window: int, most: int) -> tuple[list[bool], int | None, int]:
    """Fixed windows anchored at the first request: (allowed by request, window start, requests let through in it)."""
    out = []
    for t in times:
        if start is None or t - start >= window:
            start, count = t, 0
        out.append(count < most)
        count += count < most
    return out, start, count


def rate_limited(requests: DataFrame, principal: str, at: str, window: int, most: int) -> DataFrame:
    """`allowed` per request; the rows of a principal are streamed in time order, so a busy one needs no more memory."""
    import pandas as pd

    columns = requests.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", allowed boolean"

    def fold(frames):
        state: dict = {}
        for pdf in frames:
            allowed = []
            for who, times in ((w, g[at].tolist()) for w, g in pdf.groupby(principal, sort=False, dropna=False)):
                if who not in state:
                    state.clear()
                marks, start, count = _admit(times, *state.get(who, (None, 0)), window, most)
                state = {who: (start, count)}
                allowed += marks
            yield pdf.assign(allowed=pd.array(allowed, dtype="boolean"))[[*columns, "allowed"]]

    ordered = requests.repartition(principal).sortWithinPartitions(principal, at, *[c for c in columns if c not in (principal, at)])
    return ordered.mapInPandas(fold, schema)


def link_by(left: DataFrame, right: DataFrame, on: str, missing: Column, value: str) -> DataFrame:
    """left with right's value, or what stands for a missing one."""
    return left.join(right, on, "left").withColumn(value, F.coalesce(F.col(value), missing))
