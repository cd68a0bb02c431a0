"""Set operations, merges, dedupe, log folding, lifecycle and keyset reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnset.functions import text as T
from cairnset.operators import notes as N
from cairnset.operators import retrieval as R
from cairnset.plans import views as V
from cairnset.plans.registry import registry
from cairnset.session import table

QUERIES, ORACLE, query = registry()
w = V.with_views
NOW = 1_780_000_000


@query(w(V.EDGES, then="SELECT from_id AS id FROM edges_v WHERE kind = 'relates_to' UNION SELECT to_id FROM edges_v WHERE kind = 'relates_to'"))
def set_union_distinct(spark, d):
    e = V.edges(spark, d).where("kind = 'relates_to'")
    return e.select(F.col("from_id").alias("id")).union(e.select("to_id")).distinct()


@query(w(V.FILES, then="SELECT path FROM files_v EXCEPT SELECT path FROM files_v WHERE mtime > 0"))
def set_difference(spark, d):
    """Indexed paths that were not visited any more."""
    f = V.files(spark, d)
    return f.select("path").distinct().join(f.where("mtime > 0").select("path"), "path", "left_anti")


@query("""WITH c AS (SELECT DISTINCT source_commit AS sha FROM relay_pushes WHERE source_commit IS NOT NULL), h AS (SELECT DISTINCT source_ref AS sha FROM notes WHERE source_ref IS NOT NULL AND kind = 'decision')
SELECT sha FROM c WHERE sha NOT IN (SELECT sha FROM h)""")
def set_new_items(spark, d):
    c = table(spark, d, "relay_pushes").where("source_commit is not null").select(F.col("source_commit").alias("sha")).distinct()
    return c.join(table(spark, d, "notes").where("kind = 'decision'").select(F.col("source_ref").alias("sha")), "sha", "left_anti")


_UNITED = "list_filter(list_transform(list_concat(coalesce({0}, []), coalesce({1}, [])), lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '')"


@query(w(V.NOTES, then=f"""SELECT id, string_agg(t, '|' ORDER BY pos) AS united FROM (SELECT id, t, min(pos) AS pos FROM (
  SELECT id, unnest({_UNITED.format('tags', 'linked_files')}) AS t, generate_subscripts({_UNITED.format('tags', 'linked_files')}, 1) AS pos FROM notes_v) GROUP BY id, t) GROUP BY id"""))
def csv_union(spark, d):
    """Both lists in order, without blanks and repeats."""
    u = V.notes(spark, d).select("id", T.csv_union(F.col("tags"), F.col("linked_files")).alias("u"))
    return u.where("size(u) > 0").select("id", F.array_join("u", "|").alias("united"))


@query(w(V.NOTES, then="""SELECT id, array_to_string(list_filter(list_transform(string_split(array_to_string(list_filter(tags, lambda x: x IS NOT NULL), ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts
FROM notes_v WHERE tags IS NOT NULL"""))
def split_csv(spark, d):
    n = V.notes(spark, d).where("tags is not null")
    return n.select("id", F.array_join(T.split_csv(F.array_join("tags", " , ")), "|").alias("parts"))


_JSON = "'\"' || replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '\"'"


@query(f"""SELECT DISTINCT id, sha256('{{"body":' || {_JSON.format('body')} || ',"kind":' || {_JSON.format('kind')} || ',"title":' || {_JSON.format('title')} || '}}') AS entity FROM notes""")
def entity_id(spark, d):
    return table(spark, d, "notes").distinct().select("id", T.entity_id(F.col("kind"), F.col("title"), F.col("body")).alias("entity"))


_OLD = "old AS (SELECT id, title, tags, coalesce(entity_id, 'e' || id) AS entity FROM notes_v WHERE status = 'archived')"
_NEW = "new AS (SELECT id, title, tags, coalesce(entity_id, 'e' || id) AS entity FROM notes_v WHERE status = 'active')"


def _old_new(spark, d):
    n = V.notes(spark, d).select("id", "title", "tags", "status", F.coalesce("entity_id", F.concat(F.lit("e"), F.col("id").cast("string"))).alias("entity"))
    return n.where("status = 'archived'"), n.where("status = 'active'")


_LISTED = "list_sort(list_distinct(flatten(list({0}) FILTER ({0} IS NOT NULL))))"
_CLEAN = "list_filter(list_transform({0}, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '')"


@query(w(V.NOTES, then=f"""SELECT entity, arg_min(id, (late, id)) AS id, min(late) = 1 AS created, nullif(array_to_string({_LISTED.format(_CLEAN.format('tags'))}, '|'), '') AS tags FROM (
  SELECT coalesce(entity_id, 'e' || id) AS entity, id, tags, CASE WHEN status = 'archived' THEN 0 ELSE 1 END AS late FROM notes_v) GROUP BY entity"""))
def insert_idempotent(spark, d):
    """New notes (the active ones) against stored ones by entity: a known entity keeps its id and unites its lists."""
    n = V.notes(spark, d).select("id", "tags", "linked_files", "status", F.coalesce("entity_id", F.concat(F.lit("e"), F.col("id").cast("string"))).alias("entity"))
    out = N.insert_idempotent(n.where("status = 'archived'"), n.where("status <> 'archived'"), "entity")
    return out.select("entity", "id", "created", F.nullif(F.array_join(F.array_sort("tags"), "|"), F.lit("")).alias("tags"))


@query(w(V.FILES, then="""SELECT coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.hash, o.hash) AS hash, coalesce(n.mtime, o.mtime) AS mtime FROM (SELECT * FROM files_v WHERE indexed_at < 1775000000) o
FULL JOIN (SELECT file_id, CASE WHEN language IS NULL THEN NULL ELSE 'h' || file_id END AS hash, mtime + 5 AS mtime FROM files_v WHERE indexed_at > 1745000000) n ON n.file_id = o.file_id"""))
def upsert_file(spark, d):
    f = V.files(spark, d)
    new = f.where("indexed_at > 1745000000").select("file_id", F.when(F.col("language").isNotNull(), F.concat(F.lit("h"), F.col("file_id").cast("string"))).alias("hash"), (F.col("mtime") + 5).alias("mtime"))
    return N.upsert(f.where("indexed_at < 1775000000").select("file_id", "hash", "mtime"), new, ["file_id"])


@query(w(V.EDGES, then="""SELECT from_id, to_id, kind, created_at FROM edges_v WHERE kind = 'relates_to' UNION ALL SELECT from_id, to_id, kind, min(c) FROM (
  SELECT from_id, to_id, kind, created_at + 1 AS c FROM edges_v UNION ALL SELECT from_id, to_id, kind, created_at + 2 FROM edges_v) WHERE kind <> 'relates_to' GROUP BY from_id, to_id, kind"""))
def insert_or_ignore(spark, d):
    e = V.edges(spark, d)
    add = lambda k: e.withColumn("created_at", F.col("created_at") + k)
    return N.insert_or_ignore(e.where("kind = 'relates_to'"), add(1).union(add(2)), ["from_id", "to_id", "kind"])


@query(w(V.EDGES, then="SELECT from_id, to_id, kind FROM edges_v WHERE from_id NOT IN (SELECT from_id FROM edges_v WHERE kind = 'contradicts') UNION ALL SELECT from_id, -to_id, kind FROM edges_v WHERE kind = 'contradicts'"))
def replace_edges(spark, d):
    e = V.edges(spark, d).select("from_id", "to_id", "kind")
    return N.replace_where(e, e.where("kind = 'contradicts'").withColumn("to_id", -F.col("to_id")), ["from_id"])


@query(w(V.FILES, V.CHUNKS, then="""SELECT c.chunk_id, c.file_id, v.chunk_id IS NOT NULL AS has_vector FROM chunks_v c LEFT JOIN (SELECT DISTINCT chunk_id FROM embed_vectors) v USING (chunk_id)
WHERE c.file_id NOT IN (SELECT file_id FROM files_v WHERE project = 'lantern')"""))
def delete_file(spark, d):
    """A project's files go, and with them their chunks and vectors."""
    gone = V.files(spark, d).where("project = 'lantern'").select("file_id")
    v = table(spark, d, "embed_vectors").select("chunk_id", F.lit(True).alias("has_vector")).distinct()
    return V.chunks(spark, d).join(gone, "file_id", "left_anti").join(v, "chunk_id", "left").select("chunk_id", "file_id", F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


@query(w(V.NOTES, then="SELECT id, CASE WHEN status = 'active' AND kind = 'handoff' THEN 'archived' ELSE status END AS status, invalid_at FROM notes_v"))
def archive(spark, d):
    """Archiving leaves invalid_at alone, so an archived note stays visible as of an instant."""
    s = F.when((F.col("status") == "active") & (F.col("kind") == "handoff"), "archived").otherwise(F.col("status"))
    return V.notes(spark, d).select("id", s.alias("status"), "invalid_at")


def _mapping(spark, d):
    return V.notes(spark, d).where("kind = 'question'").select("id", (F.col("id") + 1).alias("new_id"))


_SUP = f"""s AS (SELECT n.*, m.new_id, m.new_id IS NOT NULL AND n.status = 'active' AS hit FROM notes_v n LEFT JOIN (SELECT id, id + 1 AS new_id FROM notes_v WHERE kind = 'question') m USING (id))"""


@query(w(V.NOTES, _SUP, then=f"SELECT id, CASE WHEN hit THEN 'archived' ELSE status END AS status, CASE WHEN hit THEN new_id ELSE superseded_by END AS superseded_by, CASE WHEN hit THEN coalesce(invalid_at, {NOW}) ELSE invalid_at END AS invalid_at FROM s"))
def supersede(spark, d):
    return N.supersede(V.notes(spark, d), _mapping(spark, d), NOW)[0].select("id", "status", "superseded_by", "invalid_at")


@query(w(V.NOTES, _SUP, then=f"SELECT new_id AS from_id, id AS to_id, 'supersedes' AS kind, CAST({NOW} AS BIGINT) AS created_at FROM s WHERE hit"))
def supersede_edges(spark, d):
    return N.supersede(V.notes(spark, d), _mapping(spark, d), NOW)[1]


_KEYED = "k AS (SELECT n.*, sha256(lower(kind || '|' || title)) AS ent FROM notes_v n)"
_DEDUPE = """h AS (SELECT ent, arg_min(id, (created_at, id)) AS survivor, count(*) AS copies FROM k GROUP BY ent),
redirect AS (SELECT k.id, h.survivor FROM k JOIN h USING (ent) WHERE h.copies > 1 AND k.id <> h.survivor),
p AS (SELECT k.*, coalesce(r.survivor, k.superseded_by) AS pointer, h.survivor, h.copies FROM k JOIN h USING (ent) LEFT JOIN redirect r ON r.id = k.superseded_by),
t AS (SELECT ent, string_agg(tag, '|' ORDER BY c, i, pos) AS tags FROM (SELECT ent, tag, first(created_at ORDER BY created_at, id, pos) AS c, first(id ORDER BY created_at, id, pos) AS i, first(pos ORDER BY created_at, id, pos) AS pos
  FROM (SELECT ent, created_at, id, trim(unnest(tags)) AS tag, generate_subscripts(tags, 1) AS pos FROM p WHERE copies > 1) WHERE tag <> '' GROUP BY ent, tag) GROUP BY ent),
g AS (SELECT ent, survivor AS id, CASE WHEN bool_or(p.status = 'archived') THEN 'archived' ELSE 'active' END AS status,
  first(pointer ORDER BY created_at, p.id) FILTER (pointer IS NOT NULL AND pointer <> survivor) AS superseded_by, coalesce(max(t.tags), '') AS tags FROM p LEFT JOIN t USING (ent) WHERE copies > 1 GROUP BY ent, survivor)"""


def _keyed(spark, d):
    return V.notes(spark, d).withColumn("entity_id", F.sha2(F.lower(F.concat_ws("|", "kind", "title")), 256))


@query(w(V.NOTES, _KEYED, _DEDUPE, then="""SELECT id, status, superseded_by, tags FROM g UNION ALL
SELECT id, status, pointer, array_to_string(list_filter(tags, lambda x: x IS NOT NULL), '|') FROM p WHERE copies = 1"""))
def dedupe_entities(spark, d):
    kept, _ = N.dedupe_entities(_keyed(spark, d))
    return kept.select("id", "status", "superseded_by", F.coalesce(F.array_join("tags", "|"), F.lit(None)).alias("tags"))


@query(w(V.NOTES, _KEYED, _DEDUPE, then="SELECT (SELECT count(*) FROM h WHERE copies > 1) AS groups, (SELECT count(*) FROM redirect) AS removed, (SELECT count(*) FROM k JOIN redirect r ON r.id = k.superseded_by) AS redirected"))
def dedupe_dry_run(spark, d):
    """The counts of the same dedupe, nothing changed."""
    n = _keyed(spark, d)
    _, redirect = N.dedupe_entities(n)
    a = redirect.agg(F.countDistinct("survivor").alias("groups"), F.count(F.lit(1)).alias("removed"))
    b = n.join(redirect.select(F.col("id").alias("superseded_by")), "superseded_by").agg(F.count(F.lit(1)).alias("redirected"))
    return a.crossJoin(b)  # single rows


_LOG = """lg AS (SELECT sha256(lower(kind || '|' || title)) AS entity_id, CASE WHEN kind = 'note' THEN 0 ELSE 1 END AS schema_version, kind, status, created_at, id, source_ref, remote_id, superseded_by, valid_at, invalid_at,
  list_filter(coalesce(tags, []), lambda x: x IS NOT NULL) AS tags, list_filter(coalesce(linked_files, []), lambda x: x IS NOT NULL) AS linked_files,
  'n' || superseded_by AS sup, coalesce(source_ref, 'none') AS "commit" FROM notes_v)"""


def _log(spark, d):
    clean = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())
    return V.notes(spark, d).select(
        F.sha2(F.lower(F.concat_ws("|", "kind", "title")), 256).alias("entity_id"), F.when(F.col("kind") == "note", 0).otherwise(1).alias("schema_version"), "kind", "status", "created_at", "id", "source_ref", "remote_id",
        "superseded_by", "valid_at", "invalid_at", clean("tags").alias("tags"), clean("linked_files").alias("linked_files"),
        F.concat(F.lit("n"), F.col("superseded_by").cast("string")).alias("superseded_by_entity_id"), F.coalesce("source_ref", F.lit("none")).alias("commit"))


@query(w(V.NOTES, _LOG, then="""SELECT entity_id, first(id ORDER BY created_at, id) AS id, min(created_at) AS created_at, CASE WHEN bool_or(status = 'archived') THEN 'archived' ELSE first(status ORDER BY created_at, id) END AS status,
max(schema_version) AS schema_version, min(valid_at) AS valid_at, min(invalid_at) AS invalid_at, first(sup ORDER BY created_at DESC, id) FILTER (sup IS NOT NULL) AS superseded_by_entity_id,
CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list_distinct(flatten(list(tags)))), '|') ELSE array_to_string(first(tags), '|') END AS tags FROM lg GROUP BY entity_id"""))
def fold_records(spark, d):
    f = N.fold_records(_log(spark, d).drop("commit"))
    return f.select("entity_id", "id", "created_at", "status", "schema_version", "valid_at", "invalid_at", "superseded_by_entity_id", F.array_join("tags", "|").alias("tags"))


@query(w(V.NOTES, _LOG, then="""SELECT * FROM (SELECT entity_id, min(created_at) AS created_at FROM lg WHERE kind = 'decision' GROUP BY entity_id ORDER BY created_at DESC, entity_id LIMIT 20) ORDER BY created_at, entity_id"""))
def fold_list(spark, d):
    """The folded notes of one kind, the last twenty, oldest first."""
    f = N.fold_records(_log(spark, d).drop("commit")).where("kind = 'decision'").select("entity_id", "created_at")
    return f.orderBy(F.desc("created_at"), "entity_id").limit(20).orderBy("created_at", "entity_id")


@query(w(V.NOTES, _LOG, then='SELECT entity_id, first("commit" ORDER BY created_at, id) AS "commit" FROM lg GROUP BY entity_id'))
def anchor_commits(spark, d):
    return N.anchor_commits(_log(spark, d))


@query(w(V.NOTES, then=f"""SELECT c.entity, c.archived, c.created_at, c.rows, c.tags, CASE WHEN p.entity <> c.entity THEN p.entity END AS superseded_by_entity, c.pointer IS NOT NULL AND p.entity IS NULL AS unresolved FROM (
  SELECT entity, bool_or(status = 'archived') AS archived, min(created_at) AS created_at, count(*) AS rows, nullif(array_to_string({_LISTED.format(_CLEAN.format('tags'))}, '|'), '') AS tags,
    arg_min(superseded_by, (created_at, id)) FILTER (status = 'archived' AND superseded_by IS NOT NULL) AS pointer
  FROM (SELECT *, lower(kind || '/' || title) AS entity FROM notes_v) GROUP BY entity) c LEFT JOIN (SELECT id, lower(kind || '/' || title) AS entity FROM notes_v) p ON p.id = c.pointer"""))
def reconcile_collapse(spark, d):
    """Copies of one entry in one row, with the entity that supersedes it."""
    n = V.notes(spark, d).withColumn("entity", F.lower(F.concat_ws("/", "kind", "title")))
    return N.collapse(n, "entity").select("entity", "archived", "created_at", "rows", F.nullif(F.array_join(F.array_sort("tags"), "|"), F.lit("")).alias("tags"), "superseded_by_entity", "unresolved")


@query("""WITH r AS (SELECT DISTINCT kind, title, body FROM relay_pulled WHERE body IS NOT NULL), n AS (SELECT DISTINCT kind, title, body FROM notes)
SELECT kind, title FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.kind = r.kind AND n.title = r.title AND n.body = r.body)""")
def reconcile_import(spark, d):
    """Pulled notes whose content is not stored yet."""
    key = ["kind", "title", "body"]
    r = table(spark, d, "relay_pulled").where("body is not null").select(*key).distinct()
    return r.join(table(spark, d, "notes").select(*key), key, "left_anti").select("kind", "title")


@query(w(V.NOTES, then="""SELECT coalesce(sum(rows) FILTER (present), 0)::BIGINT AS already_present, count(*) FILTER (NOT present) AS to_import, coalesce(sum(rows - 1), 0)::BIGINT AS collapsed,
  count(*) FILTER (NOT present AND other <> entity) AS linked, count(*) FILTER (NOT present AND pointer IS NOT NULL AND other IS NULL) AS unresolved FROM (
  SELECT c.*, p.entity AS other, c.entity IN (SELECT lower(kind || '/' || title) FROM relay_pulled WHERE project = 'lantern') AS present FROM (
    SELECT entity, count(*) AS rows, arg_min(superseded_by, (created_at, id)) FILTER (status = 'archived' AND superseded_by IS NOT NULL) AS pointer
    FROM (SELECT *, lower(kind || '/' || title) AS entity FROM notes_v) GROUP BY entity) c LEFT JOIN (SELECT id, lower(kind || '/' || title) AS entity FROM notes_v) p ON p.id = c.pointer)"""))
def reconcile_project(spark, d):
    """What reading the notes into a store that holds a project's pulled entries does."""
    name = F.lower(F.concat_ws("/", "kind", "title")).alias("entity")
    return N.reconcile(V.notes(spark, d).withColumn("entity", name), table(spark, d, "relay_pulled").where("project = 'lantern' and kind is not null and title is not null").select(name), "entity")


@query("WITH u AS (SELECT count(DISTINCT external_id) AS n FROM relay_pushes WHERE external_id IS NOT NULL AND lower(external_id) NOT IN (SELECT uuid FROM notes WHERE uuid IS NOT NULL)) SELECT nullif(n, 0) AS unseen FROM u")
def reconcile_count(spark, d):
    p = table(spark, d, "relay_pushes").where("external_id is not null").select("external_id", F.lower("external_id").alias("uuid"))
    u = p.join(table(spark, d, "notes").where("uuid is not null").select("uuid"), "uuid", "left_anti").agg(F.countDistinct("external_id").alias("n"))
    return u.select(F.nullif("n", F.lit(0)).alias("unseen"))


@query(w(V.NOTES, then="""SELECT id, kind FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC, id) AS rn FROM notes_v WHERE kind IN ('decision', 'requirement')
AND (list_contains(tags, 'locked') OR list_contains(tags, 'cross-project'))) WHERE rn <= 500"""))
def cross_project_notes(spark, d):
    n = V.notes(spark, d).where(F.col("kind").isin("decision", "requirement") & F.coalesce(F.arrays_overlap("tags", F.array(F.lit("locked"), F.lit("cross-project"))), F.lit(False)))
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("created_at"), "id"))
    return n.withColumn("rn", place).where("rn <= 500").select("id", "kind")


@query(w(V.NOTES, then="""SELECT remote_id, entity_id, CASE WHEN known IS NOT NULL THEN 'known' WHEN linked IS NULL AND rn = 1 THEN 'created' ELSE 'linked' END AS action, coalesce(known, linked) AS id, archived FROM (
  SELECT *, row_number() OVER (PARTITION BY known IS NULL AND linked IS NULL, entity_id ORDER BY seen, remote_id) AS rn FROM (
    SELECT r.*, k.id AS known, l.id AS linked FROM (
      SELECT remote_id, arg_min(entity, (seen, entity)) AS entity_id, min(seen) AS seen, bool_or(coalesce(archived, false)) AS archived FROM (
        SELECT lower(trim(remote_id)) AS remote_id, sha256(kind || '/' || title || '/' || coalesce(body, '')) AS entity, received_at AS seen, archived FROM relay_pulled WHERE remote_id IS NOT NULL) GROUP BY remote_id) r
    LEFT JOIN (SELECT remote_id, min(id) AS id FROM notes_v WHERE remote_id IS NOT NULL GROUP BY remote_id) k USING (remote_id)
    LEFT JOIN (SELECT sha256(kind || '/' || title || '/' || coalesce(body, '')) AS entity_id, min(id) AS id FROM notes_v GROUP BY 1) l USING (entity_id)))"""))
def sync_apply_remote(spark, d):
    """Pulled rows onto stored notes: by remote id, else by content, else new; archived propagates."""
    entity = F.sha2(F.concat_ws("/", "kind", "title", F.coalesce("body", F.lit(""))), 256)
    r = table(spark, d, "relay_pulled").select(F.lower(F.trim("remote_id")).alias("remote_id"), entity.alias("entity_id"), F.col("received_at").alias("at"), "archived")
    return N.apply_remote(V.notes(spark, d).select("id", "remote_id", entity.alias("entity_id")), r)


@query(w(V.NOTES, then="SELECT id, (row_number() OVER (ORDER BY created_at, id) - 1) // 50 AS batch FROM notes_v WHERE status = 'active' AND remote_id IS NULL"))
def rows_for_sync(spark, d):
    n = V.notes(spark, d, "remote_id").where("status = 'active' and remote_id is null").select("id", "created_at")
    return N.batches(n, ["created_at", "id"], 50).select("id", "batch")


@query("""WITH p AS (SELECT batch_id, lower(trim(external_id)) AS ext, title, sent_at, row_number() OVER (PARTITION BY lower(trim(external_id)) ORDER BY sent_at, batch_id, title) AS rn FROM relay_pushes WHERE external_id IS NOT NULL)
SELECT batch_id, count(*) FILTER (rn = 1 AND ext NOT IN (SELECT uuid FROM notes WHERE uuid IS NOT NULL)) AS created, count(*) FILTER (rn > 1 OR ext IN (SELECT uuid FROM notes WHERE uuid IS NOT NULL)) AS skipped FROM p GROUP BY batch_id""")
def batch_push(spark, d):
    """Per batch: entries created, and skipped because their id is stored or came before.

    First copies are found by one aggregate over id (map-side combined), not by ranking every copy of a hot id.
    """
    p = table(spark, d, "relay_pushes").where("external_id is not null").select("batch_id", F.lower(F.trim("external_id")).alias("ext"), "title", "sent_at")
    firsts = p.groupBy("ext").agg(F.min(F.struct("sent_at", "batch_id", "title")).alias("f"))
    fresh = firsts.join(table(spark, d, "notes").select(F.col("uuid").alias("ext")), "ext", "left_anti").groupBy(F.col("f.batch_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("created"))
    all_ = p.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    made = F.coalesce("created", F.lit(0))
    return all_.join(fresh, "batch_id", "left").select("batch_id", made.alias("created"), (F.col("n") - made).alias("skipped"))


@query(w(V.NOTES, then="SELECT id, coalesce(uuid, '00000000-0000-7000-8000-' || lpad(CAST(id AS VARCHAR), 12, '0')) AS uuid FROM notes_v"))
def uuid_backfill(spark, d):
    """Missing uuids from a supplied rule, so that runs agree."""
    return V.notes(spark, d, "uuid").select("id", F.coalesce("uuid", F.concat(F.lit("00000000-0000-7000-8000-"), F.lpad(F.col("id").cast("string"), 12, "0"))).alias("uuid"))


@query(w(V.NOTES, then="SELECT id, coalesce(remote_id, 'r' || id) AS remote_id, CASE WHEN status = 'active' THEN NULL ELSE superseded_by END AS superseded_by FROM notes_v WHERE kind <> 'handoff'"))
def dml_rows(spark, d):
    """Single-row writes as projections: a remote id only where none is set, a pointer cleared, a note deleted."""
    n = V.notes(spark, d).where("kind <> 'handoff'")
    return n.select("id", F.coalesce("remote_id", F.concat(F.lit("r"), F.col("id").cast("string"))).alias("remote_id"), F.when(F.col("status") != "active", F.col("superseded_by")).alias("superseded_by"))


@query("""SELECT model, dim, CASE WHEN dim <> 64 THEN 'error: dimension' WHEN model = 'none' THEN 'adopt' WHEN model <> 'm0' THEN 'error: model' ELSE 'ok' END AS verdict, count(*) AS n FROM (
  SELECT len(vector) AS dim, CASE WHEN chunk_id < '4' THEN 'none' WHEN chunk_id < 'e' THEN 'm0' ELSE 'm1' END AS model FROM embed_vectors WHERE vector IS NOT NULL) GROUP BY model, dim""")
def guard_provenance(spark, d):
    """Whether vectors may enter an index of 64 numbers of model m0; an unset model is adopted (models dealt by id, to have some)."""
    model = F.when(F.col("chunk_id") < "4", "none").when(F.col("chunk_id") < "e", "m0").otherwise("m1")
    v = table(spark, d, "embed_vectors").where("vector is not null").select(F.size("vector").cast("long").alias("dim"), model.alias("model"))
    return v.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn("verdict", N.provenance(F.nullif(F.col("model"), F.lit("none")), F.col("dim"), "m0", 64))


@query("SELECT DISTINCT chunk_id FROM embed_vectors WHERE vector IS NULL OR len(vector) <> 64")
def migrate_vectors(spark, d):
    """Chunks to embed anew because their vector has another dimension or none."""
    return table(spark, d, "embed_vectors").where("vector is null or size(vector) <> 64").select("chunk_id").distinct()


@query(f"""WITH {V.NOTES} SELECT count(*) AS notes, count(*) FILTER (entity_id IS NULL) AS filled, (SELECT count(*) FROM (SELECT 1 FROM notes_v GROUP BY lower(kind || title) HAVING count(*) > 1)) = 0 AS may_be_unique FROM notes_v""")
def entity_backfill(spark, d):
    n = V.notes(spark, d)
    dup = n.groupBy(F.lower(F.concat("kind", "title"))).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg((F.count(F.lit(1)) == 0).alias("may_be_unique"))
    return n.agg(F.count(F.lit(1)).alias("notes"), F.count(F.when(F.col("entity_id").isNull(), 1)).alias("filled")).crossJoin(dup)  # single rows


@query("SELECT 'a' AS notes_oid, 'y' AS index_oid")
def import_state(spark, d):
    """A singleton row of which each value is replaced on its own."""
    old = spark.createDataFrame([(1, "a", "b")], "k int, notes_oid string, index_oid string")
    return N.upsert(old, spark.createDataFrame([(1, None, "y")], old.schema), ["k"]).select("notes_oid", "index_oid")


@query("""SELECT DISTINCT from_id, to_id, lower(trim(kind)) AS kind FROM memory_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND lower(trim(kind)) IN ('supersedes', 'relates_to', 'contradicts') AND from_id NOT IN (SELECT id FROM notes WHERE kind = 'handoff') AND to_id NOT IN (SELECT id FROM notes WHERE kind = 'handoff')""")
def edge_add_checked(spark, d):
    """Edges of known kinds, each triple once, those of deleted ends gone."""
    e = V.edges(spark, d).where(F.col("kind").isin("supersedes", "relates_to", "contradicts"))
    gone = table(spark, d, "notes").where("kind = 'handoff'").select("id")
    return e.join(gone.toDF("from_id"), "from_id", "left_anti").join(gone.toDF("to_id"), "to_id", "left_anti").select("from_id", "to_id", "kind")


@query(w(V.FILES, then="SELECT DISTINCT project FROM files_v WHERE project NOT IN (SELECT project FROM documents WHERE project IS NOT NULL AND lang = 'el')"))
def registry_autoclean(spark, d):
    seen = table(spark, d, "documents").where("lang = 'el'").select("project")
    return V.files(spark, d).select("project").distinct().join(seen, "project", "left_anti")


# --- keyset reads and incremental upkeep ------------------------------------------------------------------------------


@query(w(V.NOTES, then="SELECT id, created_at FROM notes_v WHERE created_at > 1750000000 AND status <> 'archived' ORDER BY created_at, id LIMIT 100"))
def stm_since_time(spark, d):
    n = V.notes(spark, d, "id").where("created_at > 1750000000 and status <> 'archived'")
    return n.select("id", "created_at").orderBy("created_at", "id").limit(100)


@query("SELECT DISTINCT remote_id FROM notes WHERE remote_id > '0197' ORDER BY remote_id LIMIT 100")
def stm_since_id(spark, d):
    return N.keyset_page(table(spark, d, "notes").where("remote_id is not null").select("remote_id").distinct(), "remote_id", "0197", 100)


@query(w(V.NOTES, then="SELECT id, created_at FROM (SELECT * FROM notes_v WHERE status = 'active' ORDER BY created_at DESC, id LIMIT 100) WHERE created_at > 1765000000"))
def stm_since_local(spark, d):
    """The limit before the filter, unlike the other two."""
    n = R.as_of(V.notes(spark, d), None).orderBy(F.desc("created_at"), "id").limit(100)
    return n.where("created_at > 1765000000").select("id", "created_at")


@query("""WITH p AS (SELECT DISTINCT remote_id FROM notes WHERE remote_id IS NOT NULL) SELECT remote_id, (row_number() OVER (ORDER BY remote_id) - 1) // 100 AS page FROM p""")
def stm_pull_pages(spark, d):
    """All keyset pages at once: the page number of each id."""
    ids = table(spark, d, "notes").where("remote_id is not null").select("remote_id").distinct()
    return N.batches(ids, ["remote_id"], 100).withColumnRenamed("batch", "page")


@query("""WITH l AS (SELECT DISTINCT uuid FROM notes WHERE uuid IS NOT NULL), s AS (SELECT lower(external_id) AS uuid, max(sent_at) AS seen FROM relay_pushes WHERE external_id IS NOT NULL GROUP BY 1),
due AS (SELECT uuid FROM s WHERE epoch_us(seen) > (SELECT median(epoch_us(sent_at)) FROM relay_pushes)), p AS (SELECT uuid FROM l WHERE uuid NOT IN (SELECT uuid FROM s))
SELECT 'pull' AS stage, uuid, uuid NOT IN (SELECT uuid FROM l) AS fresh FROM due UNION ALL SELECT 'push', uuid, false FROM p UNION ALL SELECT 'pull again', uuid, false FROM (SELECT * FROM due UNION ALL SELECT * FROM p)""")
def stm_sync_round(spark, d):
    """A later round: pull, push, and pull again from the cursor of before."""
    sent = table(spark, d, "relay_pushes").select(F.lower("external_id").alias("uuid"), F.unix_micros(F.col("sent_at").cast("timestamp")).alias("at"))
    middle = sent.agg(F.median("at").alias("m")).first().m  # one value
    return N.sync_round(table(spark, d, "notes").select("uuid"), sent, F.lit(middle))


@query(w(V.FILES, then="""SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN o.hash IS NOT DISTINCT FROM n.hash THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT project || '/' || path AS path, min(hash) AS hash FROM files_v WHERE indexed_at < 1775000000 GROUP BY 1) o
FULL JOIN (SELECT project || '/' || path AS path, min(CASE WHEN language IS NULL THEN 'x' || hash ELSE hash END) AS hash FROM files_v WHERE indexed_at > 1745000000 GROUP BY 1) n ON n.path = o.path"""))
def stm_incremental_index(spark, d):
    f = V.files(spark, d).where("path is not null").select("language", "indexed_at", F.concat_ws("/", "project", "path").alias("path"), "hash")
    one = lambda x, h: x.groupBy("path").agg(F.min(h).alias("hash"))
    new_hash = F.when(F.col("language").isNull(), F.concat(F.lit("x"), F.col("hash"))).otherwise(F.col("hash"))
    return N.incremental_diff(one(f.where("indexed_at < 1775000000"), F.col("hash")), one(f.where("indexed_at > 1745000000"), new_hash), ["path"])


_LIMIT = """e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS rn FROM events),
x(user_id, rn, event_id, sec, start, used, allowed) AS (
  SELECT user_id, rn, event_id, sec, sec, CAST(1 AS BIGINT), true FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, e.event_id, e.sec, CASE WHEN e.sec - x.start >= 86400 THEN e.sec ELSE x.start END,
    CASE WHEN e.sec - x.start >= 86400 THEN 1 WHEN x.used < 3 THEN x.used + 1 ELSE x.used END, e.sec - x.start >= 86400 OR x.used < 3 FROM x JOIN e ON e.user_id = x.user_id AND e.rn = x.rn + 1)"""


@query(f"WITH RECURSIVE {_LIMIT} SELECT event_id, user_id, allowed FROM x")
def stm_rate_limit(spark, d):
    """Three requests a day per user, the day opening at the user's first request."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_id", "user_id", at.alias("at"))
    return N.rate_limited(e, "user_id", "at", 86_400, 3).select("event_id", "user_id", "allowed")
