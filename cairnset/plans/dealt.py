"""Queries p3 (hierarchies) and p6 (repeated deliveries) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.operators import deliveries as D
from cairnset.operators import hierarchy as H
from cairnset.session import cut, table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(H.supersession_links(table(spark, sf_dir, "notes"), table(spark, sf_dir, "memory_edges")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = H.forest_roots(_links(spark, sf_dir))
    return roots.select(F.col("node").alias("note_id"), F.col("root").alias("root_id"))


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note: parent, root, depth, path from the root, whether its chain never ends, descendants."""
    links = _links(spark, sf_dir)
    roots = cut(H.forest_roots(links))
    paths = cut(H.all_paths(links, roots))
    below = H.descendants(paths).groupBy("node").agg(F.count(F.lit(1)).alias("n_descendants"))
    ids = table(spark, sf_dir, "notes").select(F.col("id").cast("long").alias("node")).where("node is not null").distinct()
    full = ids.join(links, "node", "left").join(roots, "node", "left").join(paths, "node", "left").join(below, "node", "left")
    top = F.col("parent").isNull()
    return full.select(
        F.col("node").alias("note_id"), F.col("parent").alias("parent_id"), F.coalesce("root", "node").alias("root_id"),
        F.when(top, F.lit(0)).otherwise(F.col("depth")).cast("long").alias("depth"),
        F.array_join(F.coalesce("path", F.array("node")), "/").alias("path"), F.coalesce("never_ends", F.lit(False)).alias("never_ends"),
        F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a note and another below it, also below and on cycles."""
    links = _links(spark, sf_dir)
    paths = H.all_paths(links, cut(H.forest_roots(links)))
    return H.descendants(paths).select(F.col("node").alias("note_id"), F.col("descendant").alias("descendant_id"), "distance")


_TIES = ["batch_id", "project", "kind", "title", "body", "source_commit"]


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    push = table(spark, sf_dir, "relay_pushes").select(
        F.lit("push").alias("channel"), D.message_id(F.col("external_id")).alias("message_id"), "batch_id", "project",
        F.col("sent_at").alias("arrived_at"), "kind", "title", "body", "source_commit",
        F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("boolean").alias("archived"))
    pull = table(spark, sf_dir, "relay_pulled").select(
        F.lit("pull").alias("channel"), D.message_id(F.col("remote_id")).alias("message_id"), "batch_id", "project",
        F.col("received_at").alias("arrived_at"), "kind", "title", "body", "source_commit", "created_at", "archived")
    return push.union(pull)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with a second delivery: the second rank of the operator that keeps the first."""
    known = _messages(spark, sf_dir).where("message_id is not null")
    slim = known.select("channel", "message_id", "arrived_at", "batch_id")
    second = D.ranked_deliveries(slim, ["channel", "message_id"], "arrived_at", ["batch_id"], ranks=2)
    return second.where("delivery_no = 2").select("channel", "message_id")


def p6_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one row of each message, the first to arrive; rows without an id as they are."""
    kept = D.first_deliveries(_messages(spark, sf_dir), "message_id", "arrived_at", [*_TIES, "created_at", "archived"], ["channel"])
    return kept.select(
        "channel", "message_id", "batch_id", "project", F.date_format("arrived_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("arrived_at"),
        "kind", "title", "body", "source_commit", D.instant_seconds(F.col("created_at")).alias("created_s"), "archived")


def p6_new_in_batches(spark: SparkSession, sf_dir: str, stored_up_to: int = 20) -> DataFrame:
    """Batches after `stored_up_to` against the ids already stored from the earlier ones (relay_pulled)."""
    rows = _messages(spark, sf_dir).where("channel = 'pull'")
    stored = rows.where((F.col("batch_id") <= stored_up_to) & F.col("message_id").isNotNull())
    fresh = D.new_messages(rows.where(F.col("batch_id") > stored_up_to), stored, "message_id", "arrived_at",
                           [*_TIES, "created_at", "archived"])
    return fresh.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_new"), F.count("message_id").alias("n_with_id"), F.min("message_id").alias("least_id"))


_LINKS_SQL = """
ids AS (SELECT DISTINCT id FROM notes),
raw AS (SELECT id AS note_id, superseded_by AS parent_id FROM notes
  UNION ALL SELECT to_id, from_id FROM memory_edges WHERE lower(trim(kind)) = 'supersedes'),
l AS (SELECT note_id, min(parent_id) AS parent_id FROM raw
  WHERE parent_id IS NOT NULL AND note_id IN (SELECT id FROM ids) AND parent_id IN (SELECT id FROM ids) GROUP BY note_id),
anc(note_id, anc) AS (SELECT note_id, parent_id FROM l
  UNION SELECT a.note_id, l.parent_id FROM anc a JOIN l ON l.note_id = a.anc),
cyc AS (SELECT DISTINCT note_id FROM anc WHERE note_id = anc),
roots AS (SELECT note_id,
    coalesce(max(CASE WHEN anc NOT IN (SELECT note_id FROM l) THEN anc END),
             min(CASE WHEN anc IN (SELECT note_id FROM cyc) THEN anc END)) AS root_id,
    coalesce(bool_or(anc IN (SELECT note_id FROM cyc)), false) AS never_ends
  FROM anc GROUP BY note_id)"""

# Every note walked up until its chain ends or comes to a note it has met; the longest walk is its path.
_WALKS_SQL = """
w(note_id, top, path) AS (SELECT id, id, [id] FROM ids WHERE id IS NOT NULL
  UNION ALL SELECT w.note_id, l.parent_id, list_prepend(l.parent_id, w.path) FROM w JOIN l ON l.note_id = w.top
  WHERE NOT list_contains(w.path, l.parent_id)),
p AS (SELECT note_id, arg_max(path, len(path)) AS path FROM w GROUP BY note_id)"""

_UUID_SQL = r"""coalesce(
  CASE WHEN regexp_matches({bare}, '^[0-9a-f]{{32}}$') THEN
    regexp_replace({bare}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5') END,
  nullif(regexp_replace({c}, '^\s+|\s+$', '', 'g'), ''))"""


def _uuid_sql(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower({c}), '\s', '', 'g'), '^(urn:uuid:)|[{{}}()\-]', '', 'g')"
    return _UUID_SQL.format(bare=bare, c=c)


_MESSAGES_SQL = f"""
m AS (SELECT 'push' AS channel, {_uuid_sql('external_id')} AS message_id, batch_id, project, sent_at AS arrived_at,
    kind, title, body, source_commit, CAST(NULL AS VARCHAR) AS created_at, CAST(NULL AS BOOLEAN) AS archived FROM relay_pushes
  UNION ALL SELECT 'pull', {_uuid_sql('remote_id')}, batch_id, project, received_at,
    kind, title, body, source_commit, created_at, archived FROM relay_pulled)"""

_RANK_SQL = """row_number() OVER (PARTITION BY channel, message_id ORDER BY arrived_at NULLS LAST, batch_id NULLS FIRST,
  project NULLS FIRST, kind NULLS FIRST, title NULLS FIRST, body NULLS FIRST, source_commit NULLS FIRST,
  created_at NULLS FIRST, archived NULLS FIRST)"""

QUERIES = {
    "p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants,
    "p6_found": p6_found, "p6_messages": p6_messages, "p6_new_in_batches": p6_new_in_batches,
}

ORACLE = {
    "p3_found": f"WITH RECURSIVE {_LINKS_SQL} SELECT note_id, root_id FROM roots",
    "p3_descendants": f"""WITH RECURSIVE {_LINKS_SQL}, {_WALKS_SQL}
SELECT path[i] AS note_id, note_id AS descendant_id, CAST(len(path) - i AS BIGINT) AS distance
FROM (SELECT note_id, path, unnest(range(1, len(path))) AS i FROM p)""",
    "p3_hierarchy": f"""WITH RECURSIVE {_LINKS_SQL}, {_WALKS_SQL},
n AS (SELECT path[i] AS note_id, count(*) AS n FROM (SELECT path, unnest(range(1, len(path))) AS i FROM p) GROUP BY 1)
SELECT p.note_id, l.parent_id, coalesce(r.root_id, p.note_id) AS root_id,
  CASE WHEN r.never_ends THEN NULL ELSE CAST(len(p.path) - 1 AS BIGINT) END AS depth, array_to_string(p.path, '/') AS path,
  coalesce(r.never_ends, false) AS never_ends, coalesce(n.n, 0) AS n_descendants
FROM p LEFT JOIN l ON l.note_id = p.note_id LEFT JOIN roots r ON r.note_id = p.note_id LEFT JOIN n ON n.note_id = p.note_id""",
    "p6_found": f"""WITH {_MESSAGES_SQL} SELECT channel, message_id FROM m
WHERE message_id IS NOT NULL GROUP BY channel, message_id HAVING count(*) > 1""",
    "p6_messages": f"""WITH {_MESSAGES_SQL},
k AS (SELECT *, {_RANK_SQL} AS rn FROM m WHERE message_id IS NOT NULL
  UNION ALL SELECT *, 1 FROM m WHERE message_id IS NULL)
SELECT channel, message_id, batch_id, project, strftime(arrived_at, '%Y-%m-%d %H:%M:%S.%f') AS arrived_at, kind, title, body,
  source_commit, coalesce(CASE WHEN regexp_matches(created_at, '^-?[0-9]+$') THEN CAST(created_at AS BIGINT) END,
    CAST(floor(epoch(TRY_CAST(created_at AS TIMESTAMPTZ))) AS BIGINT)) AS created_s, archived FROM k WHERE rn = 1""",
    "p6_new_in_batches": f"""WITH {_MESSAGES_SQL}, p AS (SELECT * FROM m WHERE channel = 'pull'),
s AS (SELECT DISTINCT message_id FROM p WHERE batch_id <= 20 AND message_id IS NOT NULL),
k AS (SELECT *, {_RANK_SQL} AS rn FROM p WHERE batch_id > 20 AND message_id IS NOT NULL
  UNION ALL SELECT *, 1 FROM p WHERE batch_id > 20 AND message_id IS NULL)
SELECT project, count(*) AS n_new, count(message_id) AS n_with_id, min(message_id) AS least_id FROM k
WHERE rn = 1 AND (message_id IS NULL OR message_id NOT IN (SELECT message_id FROM s)) GROUP BY project""",
}
