"""Queries p1, p2, p4, p5, p7, p8, p9 and p10 and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.llm import lookalikes as L
from cairnset.llm import mixing as M
from cairnset.llm import neighbours as N
from cairnset.llm import packing as P
from cairnset.llm import provenance as R
from cairnset.llm import quantiles as Q
from cairnset.llm import splitting as S
from cairnset.llm import survivors as V
from cairnset.llm import tokens as K
from cairnset.operators.retrieval import near_in_blocks
from cairnset.session import cut, salted_join, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- p1: percentiles -------------------------------------------------------------------------------------------------

P1_BY, P1_MEASURES, P1_EPS = ["condition", "model"], ["wall_seconds", "input_tokens"], 0.01
P1_AT = [0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _p1_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests kept of each received_on day."""
    runs = Q.once_per_run(table(spark, sf_dir, "harness_runs"))
    salts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # a day may hold a third of all rows
    dealt = runs.repartition("received_on", F.pmod(F.xxhash64("wall_seconds", "input_tokens"), F.lit(salts)))
    day = [*P1_BY, "received_on"]
    return cut(Q.merge_digests(Q.digest_groups(dealt, day, P1_MEASURES, P1_EPS), day, P1_EPS, salts=1))


def _p1_merged(days: DataFrame) -> DataFrame:
    return Q.read_quantiles(Q.merge_digests(days, P1_BY, P1_EPS), P1_BY, P1_AT)


@query
def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by condition and model: of each received_on day from its kept digests, and (day null) of all days merged."""
    days = _p1_days(spark, sf_dir)
    each = Q.read_quantiles(days, [*P1_BY, "received_on"], P1_AT)
    return _p1_merged(days).withColumn("received_on", F.lit(None).cast("date")).unionByName(each)


@query
def p1_in_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles over all days at once, from one digest per task."""
    runs = Q.once_per_run(table(spark, sf_dir, "harness_runs"))
    merged = Q.merge_digests(Q.digest_groups(runs, P1_BY, P1_MEASURES, P1_EPS), P1_BY, P1_EPS)
    return Q.read_quantiles(merged, P1_BY, P1_AT)


@query
def p1_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rank of each merged daily percentile is within the promised error, counted exactly."""
    runs = Q.once_per_run(table(spark, sf_dir, "harness_runs"))
    found = _p1_merged(_p1_days(spark, sf_dir))
    long = runs.select(*P1_BY, F.explode(F.map_from_arrays(
        F.array(*[F.lit(m) for m in P1_MEASURES]),
        F.array(*[F.col(m).cast("double") for m in P1_MEASURES]))).alias("measure", "value"))
    long = long.where("value >= 0 and not isnan(value)")
    asked = found.groupBy(*P1_BY, "measure").agg(F.collect_list(F.struct("percentile", "estimate")).alias("asked"))
    same = [long[c].eqNullSafe(asked[c]) for c in [*P1_BY, "measure"]]
    # one row per group with at most a few dozen estimates: bounded by the number of groups, not of runs
    each = long.join(asked, same).select(*[long[c] for c in [*P1_BY, "measure"]], "value", F.explode("asked").alias("a"))
    cell = F.col("a.estimate") * (1 + 2.0 ** -20)
    counted = each.groupBy(*P1_BY, "measure", F.col("a.percentile").alias("percentile")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("value") < F.col("a.estimate"), 1)).alias("below"),
        F.count(F.when(F.col("value") <= cell, 1)).alias("upto"))
    target, slack = F.col("percentile") / 100 * F.col("n"), F.lit(P1_EPS) * F.col("n") + 1
    return counted.select(*P1_BY, "measure", F.col("percentile").cast("int").alias("percentile"), "n",
                          ((F.col("below") <= target + slack) & (F.col("upto") >= target - slack)).alias("within"))


ORACLE["p1_rank_check"] = r"""
WITH d AS (SELECT run_id, min(received_on) AS received_on,
    any_value(trim(regexp_replace(lower(condition), '\s+', ' ', 'g'))) AS condition,
    any_value(trim(regexp_replace(lower(model), '\s+', ' ', 'g'))) AS model,
    any_value(wall_seconds) AS wall_seconds, any_value(input_tokens) AS input_tokens FROM harness_runs GROUP BY run_id),
v AS (SELECT condition, model, 'wall_seconds' AS measure, wall_seconds AS value FROM d
  UNION ALL SELECT condition, model, 'input_tokens', CAST(input_tokens AS DOUBLE) FROM d)
SELECT condition, model, measure, CAST(p AS INTEGER) AS percentile, count(*) AS n, true AS within
FROM v, (SELECT unnest([5, 25, 50, 75, 90, 95, 99]) AS p)
WHERE value >= 0 AND NOT isnan(value) GROUP BY condition, model, measure, p"""


# --- p2: oversized items ---------------------------------------------------------------------------------------------


def _limits(spark: SparkSession, sf_dir: str, prefix: str) -> list:
    """size_limits has four rows by definition."""
    return table(spark, sf_dir, "size_limits").where(F.col("limit_name").startswith(prefix)).orderBy("limit_name").collect()


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = _limits(spark, sf_dir, "embed_chunk")[0]
    chunks = table(spark, sf_dir, "embed_chunks").select("chunk_id", "file_id", "seq", "content")
    return S.split_oversized(chunks, limit.max_size, limit.overlap_size)


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 1 and chunk_id is not null").select("chunk_id")


@query
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of oversized chunks with the path and the new chunk count of their file."""
    pieces = cut(_pieces(spark, sf_dir))
    chunks = table(spark, sf_dir, "embed_chunks").select("chunk_id", "file_id").where("file_id is not null").distinct()
    per_file = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
    more = pieces.groupBy("file_id").agg(F.count(F.when(F.col("piece_no") > 0, 1)).alias("added"))
    counts = per_file.join(more, "file_id").select("file_id", (F.col("chunks") + F.col("added")).alias("file_chunk_count"))
    files = S.current_files(table(spark, sf_dir, "files")).select("file_id", "path")
    return pieces.join(counts, "file_id", "left").join(files, "file_id", "left").select(
        "chunk_id", "file_id", "path", "piece_no", "n_pieces", "start", "size", "piece", "file_chunk_count")


@query
def p2_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that gain chunks: number of oversized chunks and characters, each chunk once."""
    pieces = _pieces(spark, sf_dir)
    gained = pieces.withColumn("end", F.col("start") + F.col("size")).groupBy("chunk_id", "file_id").agg(F.max("end").alias("n_chars"), F.max("size").alias("longest"))
    return gained.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_oversized"), F.sum("n_chars").cast("long").alias("n_chars"), (F.max("longest") <= _limits(spark, sf_dir, "embed_chunk")[0].max_size).alias("within"))


@query
def p2_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each oversized chunk put together again from its pieces: a hash of its text, whether all pieces fit, whether neighbours share the overlap."""
    limit = _limits(spark, sf_dir, "embed_chunk")[0]
    pieces = _pieces(spark, sf_dir).where("chunk_id is not null")
    # the pieces of one item are as large as the item
    items = pieces.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "size", "piece"))).alias("p"))
    rest = F.concat(F.col("p")[0].piece, F.array_join(F.transform(F.slice("p", 2, F.size("p")), lambda x: F.substring(x.piece, limit.overlap_size + 1, limit.max_size)), ""))
    pairs = F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))
    shared = F.forall(pairs, lambda z: (z.b.start == z.a.start + z.a.size - limit.overlap_size) & (F.right(z.a.piece, F.lit(limit.overlap_size)) == F.left(z.b.piece, F.lit(limit.overlap_size))))
    return items.select("chunk_id", F.md5(rest).alias("hash"), (F.array_max(F.transform("p", lambda x: F.char_length(x.piece))) <= limit.max_size).alias("within"), shared.alias("shared"))


ORACLE["p2_whole"] = """SELECT DISTINCT chunk_id, md5(content) AS hash, true AS within, true AS shared FROM embed_chunks
WHERE chunk_id IS NOT NULL AND length(content) > (SELECT max_size FROM size_limits WHERE limit_name = 'embed_chunk')"""
ORACLE["p2_found"] = """SELECT DISTINCT chunk_id FROM embed_chunks
WHERE chunk_id IS NOT NULL AND length(content) > (SELECT max_size FROM size_limits WHERE limit_name = 'embed_chunk')"""
ORACLE["p2_file_counts"] = """SELECT file_id, count(*) AS n_oversized, CAST(sum(n) AS BIGINT) AS n_chars, true AS within FROM (
  SELECT DISTINCT chunk_id, file_id, length(content) AS n FROM embed_chunks
  WHERE length(content) > (SELECT max_size FROM size_limits WHERE limit_name = 'embed_chunk')) GROUP BY file_id"""


# --- p7: survivors ---------------------------------------------------------------------------------------------------


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.survivors(table(spark, sf_dir, "notes")).where("first_id <> last_id").select("first_id", "survivor_id")


@query
def p7_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per note text, copies or not, with its fields filled from all copies."""
    flat = lambda c: F.array_join(c, "|").alias(c)
    return V.survivors(table(spark, sf_dir, "notes")).select(
        "first_id", "survivor_id", "kind", "title", "status", "created_at", flat("tags"), flat("linked_files"), "source_ref",
        "valid_at", "remote_id", "layers", "candidates")


_COPY_SQL = r"""trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g'))"""
ORACLE["p7_found"] = f"""
WITH n AS (SELECT DISTINCT id, {_COPY_SQL.format('kind')} AS k, {_COPY_SQL.format('title')} AS t, {_COPY_SQL.format('body')} AS b,
    CASE WHEN lower(trim(status)) = 'active' THEN 1 ELSE 0 END AS trust,
    CASE WHEN created_at >= 100000000000 THEN created_at // 1000 ELSE created_at END AS recency,
    CAST(len(list_filter(coalesce(tags, []), lambda x: trim(coalesce(x, '')) <> '')) > 0 AS INT)
      + CAST(len(list_filter(coalesce(linked_files, []), lambda x: trim(coalesce(x, '')) <> '')) > 0 AS INT)
      + CAST(source_ref IS NOT NULL AS INT) + CAST(valid_at IS NOT NULL AS INT) + CAST(remote_id IS NOT NULL AS INT) AS filled FROM notes),
r AS (SELECT *, row_number() OVER (PARTITION BY k, t, b ORDER BY trust DESC, filled DESC, recency DESC, id) AS rn,
    min(id) OVER (PARTITION BY k, t, b) AS first_id, max(id) OVER (PARTITION BY k, t, b) AS last_id FROM n)
SELECT first_id, id AS survivor_id FROM r WHERE rn = 1 AND first_id <> last_id"""


# Every copy by its own layer: the longest chain of copies above it.
ORACLE["p7_survivors"] = rf"""
WITH RECURSIVE n AS (SELECT DISTINCT ON (id) id, kind, title, {_COPY_SQL.format('kind')} || chr(1) || {_COPY_SQL.format('title')} || chr(1) || {_COPY_SQL.format('body')} AS k,
    trim(regexp_replace(lower(status), '\s+', ' ', 'g')) AS status,
    CASE WHEN created_at >= 100000000000 THEN created_at // 1000 ELSE created_at END AS created_at,
    list_filter(list_transform(tags, lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x <> '') AS tags,
    list_filter(list_transform(linked_files, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS linked_files,
    CASE WHEN trim(source_ref) <> '' THEN source_ref END AS source_ref, valid_at, CASE WHEN trim(remote_id) <> '' THEN remote_id END AS remote_id
  FROM notes WHERE id IS NOT NULL),
v AS (SELECT * REPLACE (CASE WHEN len(tags) > 0 THEN array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i), '|') END AS tags,
    CASE WHEN len(linked_files) > 0 THEN array_to_string(list_filter(linked_files, lambda x, i: list_position(linked_files, x) = i), '|') END AS linked_files),
    CASE WHEN status = 'active' THEN 1 ELSE 0 END AS t, coalesce(created_at, -4611686018427387904) AS a FROM n),
w AS (SELECT *, CAST(tags IS NOT NULL AS INT) + CAST(linked_files IS NOT NULL AS INT) + CAST(source_ref IS NOT NULL AS INT)
    + CAST(valid_at IS NOT NULL AS INT) + CAST(remote_id IS NOT NULL AS INT) AS f,
    CONCAT_WS(',', tags IS NULL, linked_files IS NULL, source_ref IS NULL, valid_at IS NULL, remote_id IS NULL) AS mask FROM v),
p AS (SELECT DISTINCT k, t, f, a FROM w),
up(k, t, f, a, layer) AS (SELECT k, t, f, a, 1 FROM p
  UNION SELECT p.k, p.t, p.f, p.a, up.layer + 1 FROM up JOIN p ON p.k = up.k AND up.t >= p.t AND up.f >= p.f AND up.a >= p.a
    AND (up.t > p.t OR up.f > p.f OR up.a > p.a)),
l AS (SELECT k, t, f, a, max(layer) AS layer FROM up GROUP BY k, t, f, a),
r AS (SELECT w.*, l.layer, row_number() OVER (PARTITION BY k ORDER BY l.layer, t DESC, f DESC, a DESC, id) AS pos,
    row_number() OVER (PARTITION BY k ORDER BY t DESC, f DESC, a DESC, id) AS best FROM w JOIN l USING (k, t, f, a))
SELECT min(id) AS first_id, arg_min(id, best) AS survivor_id, max(kind) FILTER (best = 1) AS kind, max(title) FILTER (best = 1) AS title,
  max(status) FILTER (best = 1) AS status, max(created_at) FILTER (best = 1) AS created_at,
  arg_min(tags, pos) FILTER (tags IS NOT NULL) AS tags, arg_min(linked_files, pos) FILTER (linked_files IS NOT NULL) AS linked_files,
  arg_min(source_ref, pos) FILTER (source_ref IS NOT NULL) AS source_ref, arg_min(valid_at, pos) FILTER (valid_at IS NOT NULL) AS valid_at,
  arg_min(remote_id, pos) FILTER (remote_id IS NOT NULL) AS remote_id, max(layer) AS layers, count(DISTINCT (t, mask, a)) AS candidates
FROM r GROUP BY k"""


# --- p8 and p9: packing and mixing -----------------------------------------------------------------------------------


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    docs = table(spark, sf_dir, "documents")
    limits = [(r.limit_name, r.max_size) for r in _limits(spark, sf_dir, "pack_") if r.unit == "tokens"]
    items = cut(docs.select(F.col("doc_id").alias("item_id"), K.n_tokens(F.col("text")).alias("size")))  # texts are read and counted once
    return P.pack(items, limits, items.count()), limits


@query
def p8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in windows of each pack_* limit; pieces only where a document exceeds the window."""
    windows, _ = _windows(spark, sf_dir)
    return windows.withColumnsRenamed({"item_id": "doc_id", "start": "token_start", "size": "n_tokens"})


@query
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the windows of each limit are, and that none is overfull."""
    windows, limits = _windows(spark, sf_dir)
    per_window = windows.groupBy("limit_name", "window_id").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"))
    caps = F.create_map(*[F.lit(x) for pair in limits for x in pair])
    return per_window.groupBy("limit_name").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest")).withColumn(
        "fill", F.round(F.col("tokens") / (F.col("windows") * caps[F.col("limit_name")]), 6))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    targets = {r.source: (r.target_share, r.max_repeats) for r in
               table(spark, sf_dir, "mix_targets").select(M.source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect()}  # eight rows by definition
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", M.source_name(F.col("source")).alias("source"), K.n_tokens(F.col("text")).alias("n_tokens"))
    return M.mixture(cut(docs), targets), targets


@query
def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each listed source, and how often its documents are used."""
    mixed, targets = _mixed(spark, sf_dir)
    want = spark.createDataFrame([(s, w, r) for s, (w, r) in targets.items()], "source string, target_share double, max_repeats int")
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("use_no").alias("most_uses"))
    full = want.join(got, "source", "left").na.fill(0, ["tokens", "uses", "most_uses"])
    total = full.agg(F.sum("tokens").alias("all_tokens"))
    return full.crossJoin(F.broadcast(total)).withColumn("reached_share", F.round(F.col("tokens") / F.col("all_tokens"), 6)).drop("all_tokens")  # one row beside eight


#: p8_fill and p9_shares hold tokens, which SQL cannot count; these queries hold what must be true of them.
@query
def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each limit: documents placed, whether no window is overfull, no document lost or split without need, and at most 2 % is unused."""
    windows, limits = _windows(spark, sf_dir)
    rows = cut(windows.join(F.broadcast(spark.createDataFrame(limits, "limit_name string, cap long")), "limit_name"))  # a row for each limit
    per_window = rows.groupBy("limit_name", "window_id", "cap").agg(F.sum("size").alias("used"))
    full = per_window.groupBy("limit_name").agg(
        (F.max(F.col("used") - F.col("cap")) <= 0).alias("none_overfull"), (F.sum("used") >= 0.98 * F.sum("cap") - F.max("cap")).alias("little_unused"))
    per_doc = rows.groupBy("limit_name", "item_id", "cap").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.max(F.col("start") + F.col("size")).alias("end"))
    docs = per_doc.groupBy("limit_name").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min((F.col("total") == F.col("end")) & (F.col("n") == F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("cap"))))).alias("whole"))
    return docs.join(full, "limit_name").select("limit_name", "n_docs", "whole", "none_overfull", "little_unused")


@query
def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each listed source that has documents: whether its reached share is the target share of those within half a percent and one document, no use beyond the cap."""
    mixed, targets = _mixed(spark, sf_dir)
    mixed = cut(mixed)
    want = spark.createDataFrame([(s, w, r) for s, (w, r) in targets.items()], "source string, target_share double, max_repeats long")
    uses = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"))
    got = uses.groupBy("source").agg(F.max("n").alias("most"), F.sum("tokens").alias("tokens"), F.max(F.col("tokens") / F.col("n")).alias("largest"))
    both = want.join(got, "source")
    sums = both.agg(F.sum("tokens").alias("all_tokens"), F.sum("target_share").alias("all_share"))  # one row beside eight
    return both.crossJoin(F.broadcast(sums)).select(
        "source", "target_share", (F.abs(F.col("tokens") - F.col("all_tokens") * F.col("target_share") / F.col("all_share")) <= 0.005 * F.col("all_tokens") + F.col("largest")).alias("share_met"),
        (F.col("most") <= F.col("max_repeats")).alias("within_repeats"))


ORACLE["p8_check"] = """SELECT limit_name, (SELECT count(*) FROM documents) AS n_docs, true AS whole, true AS none_overfull, true AS little_unused
FROM size_limits WHERE limit_name LIKE 'pack%' AND unit = 'tokens'"""
ORACLE["p9_check"] = r"""SELECT t.source, t.target_share, true AS share_met, true AS within_repeats
FROM (SELECT regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g') AS source, target_share FROM mix_targets) t
WHERE t.source IN (SELECT regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g') FROM documents WHERE text <> '')"""


# --- p10: look-alikes ------------------------------------------------------------------------------------------------


def _look_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("raw"), "text")
    return cut(L.fold_texts(docs, "text", ["doc_id", "raw"]).select(F.col("doc_id").alias("id"), F.md5("canonical").alias("class"), "raw"))


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.same_looking_pairs(_look_members(spark, sf_dir)).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


@query
def p10_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that reads like another with other characters, with the smallest such document and the size of its class."""
    _, inside = L.look_classes(_look_members(spark, sf_dir))
    size = inside.groupBy("class").agg(F.min("id").alias("first_doc_id"), F.count(F.lit(1)).alias("n_docs"), F.count_distinct("raw").alias("n_texts"))
    return salted_join(inside, size, "class").select(F.col("id").alias("doc_id"), "first_doc_id", "n_docs", "n_texts")


@query
def p10_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its one form."""
    return L.fold_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])


def _forms_sql() -> str:
    """Expected forms from a table of characters: texts taken apart, joined with their forms one by one and put together again."""
    single, several, jamo = L._tables()
    forms = single | several
    rows = ", ".join(f"({L._quoted(c)}, {L._quoted(f)})" for c, f in forms.items())
    nothing = "".join("-".join(rf"\x{{{p}}}" for p in x.split("-")) for x in L._NOTHING)
    emoji = f"'[{L._EMOJI}]'"
    return f"""forms(c, form) AS (VALUES {rows}),
texts AS (SELECT doc_id, text, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents WHERE text IS NOT NULL),
chars AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '(?s).') AS l FROM texts WHERE strlen(t) > length(t))),
seen AS (SELECT *, lag(c) OVER w AS before, lead(c) OVER w AS after FROM chars WHERE NOT regexp_matches(c, '[{nothing}]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
drawn AS (SELECT doc_id, i, CASE WHEN seen.c <> chr(8205) THEN coalesce(form, seen.c)
    WHEN regexp_matches(before, {emoji}) AND regexp_matches(after, {emoji}) THEN seen.c ELSE '' END AS f FROM seen LEFT JOIN forms ON forms.c = seen.c),
whole AS (SELECT doc_id, translate(nfc_normalize(string_agg(f, '' ORDER BY i)), {L._quoted(''.join(jamo))}, {L._quoted(''.join(jamo.values()))}) AS form FROM drawn GROUP BY doc_id),
looks AS (SELECT doc_id, text, CASE WHEN strlen(t) = length(t) THEN t ELSE coalesce(form, '') END AS form FROM texts LEFT JOIN whole USING (doc_id))"""


ORACLE["p10_texts"] = f"WITH {_forms_sql()} SELECT d.doc_id, form AS canonical FROM documents d LEFT JOIN looks USING (doc_id)"
ORACLE["p10_found"] = f"""WITH {_forms_sql()} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b
FROM looks a JOIN looks b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"""
ORACLE["p10_members"] = f"""WITH {_forms_sql()}, g AS (SELECT form, min(doc_id) AS first_doc_id, count(*) AS n_docs, count(DISTINCT text) AS n_texts FROM looks GROUP BY form)
SELECT doc_id, first_doc_id, n_docs, n_texts FROM looks JOIN g USING (form) WHERE n_texts > 1"""


# --- p5: files not written by hand -----------------------------------------------------------------------------------


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embed_chunks").select("file_id", "chunk_id", "seq", "content")
    return R.not_by_hand(table(spark, sf_dir, "files"), chunks)


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _provenance(spark, sf_dir).where("generated or minified or vendored or data").select("file_id")


@query
def p5_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to index: hand-written files with their project, path and language."""
    return _provenance(spark, sf_dir).where("not (generated or minified or vendored or data)").select("file_id", "project", "path", "language")


# --- p4: nearest vectors ---------------------------------------------------------------------------------------------


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nearest(table(spark, sf_dir, "embed_vectors").select(F.col("chunk_id").alias("id"), "vector"), dim=64, k=5)


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.similar_pairs(_neighbours(spark, sf_dir), 0.90).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


@query
def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest chunks of every usable chunk."""
    return _neighbours(spark, sf_dir).select(F.col("id").alias("chunk_id"), F.col("other").alias("near_chunk_id"), "place", F.round("cosine", 5).alias("cosine"))


@query
def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least nine in ten of the true neighbours are found, for every chunk whose id hashes under 5 of 256, against all chunks."""
    vectors = table(spark, sf_dir, "embed_vectors").select(F.col("chunk_id").alias("id"), "vector")
    asked = F.substring(F.md5("id"), 1, 2) < "05"
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = cut(N.usable(vectors, 64).select("id", F.transform("vector", lambda x: x / length).alias("embedding")))
    exact = near_in_blocks(unit.where(asked), unit, 2.0, 5, "id").where("place = 5").select(F.col("id_a").alias("id"), (1 - F.col("distance") ** 2 / 2).alias("bound"))
    found = N.nearest(vectors, dim=64, k=5).where(asked).join(exact, "id")
    per = found.groupBy("id").agg(F.count(F.when(F.col("cosine") >= F.col("bound") - 2e-5, 1)).alias("hits"))
    return per.agg(F.count(F.lit(1)).alias("n_asked"), (F.sum("hits") >= 0.9 * 5 * F.count(F.lit(1))).alias("enough"))


ORACLE["p4_recall"] = """SELECT count(DISTINCT chunk_id) AS n_asked, true AS enough FROM embed_vectors
WHERE left(md5(chunk_id), 2) < '05' AND len(vector) = 64
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"""
# By brute force over all pairs, which SQL can afford on a small table only; the queries above never do that.
ORACLE["p4_found"] = """
WITH u AS (SELECT chunk_id, CAST(min(vector) AS DOUBLE[]) AS v FROM embed_vectors WHERE chunk_id IS NOT NULL AND len(vector) = 64
    AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
c AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM c)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE rn <= 5 AND s >= 0.9"""
