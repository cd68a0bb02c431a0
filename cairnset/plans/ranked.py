"""Queries of ranked retrieval and of the symbol graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.functions import harvest as H
from cairnset.functions import text as T
from cairnset.operators import retrieval as R
from cairnset.operators import symbols as G
from cairnset.operators import syntax as X
from cairnset.plans import views as V
from cairnset.plans.registry import registry
from cairnset.session import cut, spread, table

QUERIES, ORACLE, query = registry()

CODE_QUERY = "stale cache: lease!"
CODE_TERMS = ["stale", "cache", "lease"]
NOTE_QUERY = "the final page"
VEC_ID = 7


def _words_sql(c: str) -> str:
    return rf"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _bm25_sql(rel: str, key: str, counts: list[str], name: str = "bm") -> str:
    """CTEs scoring `rel`, which carries a list column w."""
    n = range(len(counts))
    tf = ", ".join(f"{c} AS tf{i}" for i, c in enumerate(counts))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in n)
    idf = [f"ln((n - df{i} + 0.5) / (df{i} + 0.5))" for i in n]
    s = " + ".join(f"(CASE WHEN {idf[i]} > 0 THEN {idf[i]} ELSE 1e-6 END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i in n)
    some = " OR ".join(f"tf{i} > 0" for i in n)
    return (f"{name}_c AS (SELECT *, len(w) AS dl, {tf} FROM {rel}),\n{name}_t AS (SELECT count(*) AS n, avg(dl) AS a, {df} FROM {name}_c),\n"
            f"{name} AS (SELECT {name}_c.*, {s} AS score FROM {name}_c, {name}_t WHERE {some})")


_DOCS = f"d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents)"
_DOC_BM = _DOCS + ",\n" + _bm25_sql("d", "doc_id", [f"len(list_filter(w, lambda x: x = '{t}'))" for t in CODE_TERMS])
_PHRASE = "[" + ", ".join(f"'{w}'" for w in NOTE_QUERY.split()) + "]"
_K = len(NOTE_QUERY.split())
_NOTE_BM = (V.NOTES + f",\nm AS (SELECT *, {_words_sql("concat_ws(' ' || chr(10) || ' ', title, body, array_to_string(coalesce(tags, []), ' '))")} AS w FROM notes_v),\n"
            + _bm25_sql("m", "id", [f"len(list_filter(range(1, greatest(1, len(w) - {_K - 1}) + 1), lambda i: w[i:i + {_K - 1}] = {_PHRASE}))"]))


def _vector(spark: SparkSession, d: str, vec_id: int = VEC_ID) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


def _by_doc(spark: SparkSession, d: str) -> DataFrame:
    """Vectors keyed by the document of the same number."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query(f"WITH {_DOC_BM} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 50")
def fts_code(spark, d):
    return R.fts_code(table(spark, d, "documents"), CODE_QUERY, limit=50).withColumn("score", F.round("score", 6))


@query(f"WITH {_NOTE_BM} SELECT id, round(score, 6) AS score FROM bm WHERE status = 'active' ORDER BY round(score, 9) DESC, id LIMIT 30")
def fts_memory(spark, d):
    """Phrase hits scored over all notes, then the active ones."""
    return R.fts_memory(V.notes(spark, d), NOTE_QUERY, limit=None).where("status = 'active'").orderBy(F.desc(F.round("score", 9)), "id").limit(30).select(
        "id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, replace(replace(text, chr(0), ''), '\"', '\"\"') AS quoted FROM documents")
def fts_quote(spark, d):
    return table(spark, d, "documents").select("doc_id", F.replace(F.replace(F.col("text"), F.lit("\0"), F.lit("")), F.lit('"'), F.lit('""')).alias("quoted"))


@query(f"""WITH {_NOTE_BM}, t AS (SELECT * FROM bm ORDER BY round(score, 9) DESC, id LIMIT 25)
SELECT id, kind, status, coalesce(valid_at, created_at) AS at FROM t""")
def timeline(spark, d):
    return R.timeline(V.notes(spark, d), NOTE_QUERY, 25).select("id", "kind", "status", "at")


_Q8 = "list_transform({0}, lambda x: greatest(-127, least(127, CAST(round(CAST(x AS DOUBLE) * 127) AS INTEGER))))"
_KNN8 = f"""q AS (SELECT {_Q8.format('embedding')} AS qv FROM embeddings WHERE vec_id = {VEC_ID}),
k8 AS (SELECT vec_id, list_distance(CAST({_Q8.format('embedding')} AS DOUBLE[]), CAST(qv AS DOUBLE[])) / 127 AS raw FROM embeddings, q)"""
_KNNF = f"""qf AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = {VEC_ID}),
kf AS (SELECT vec_id, label, list_distance(CAST(embedding AS DOUBLE[]), qv) AS distance FROM embeddings, qf)"""


@query(f"SELECT vec_id, array_to_string({_Q8.format('embedding')}, ',') AS codes FROM embeddings")
def quantise_int8(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_join(R.quantise_int8(F.col("embedding")).cast("array<string>"), ",").alias("codes"))


@query(f"WITH {_KNN8} SELECT vec_id, round(raw, 6) AS raw, round(0.85 * raw, 6) AS distance FROM k8 ORDER BY round(raw, 9), vec_id LIMIT 20")
def knn_int8(spark, d):
    return R.knn_int8(table(spark, d, "embeddings"), _vector(spark, d), 20).select("vec_id", F.round("raw", 6).alias("raw"), F.round("distance", 6).alias("distance"))


@query(f"WITH {_KNNF}, t AS (SELECT * FROM kf ORDER BY round(distance, 9), vec_id LIMIT 40) SELECT vec_id, round(distance, 6) AS distance FROM t WHERE label <> 1")
def knn_float(spark, d):
    """k is taken before the filter, so fewer may come back."""
    return R.knn_float(table(spark, d, "embeddings"), _vector(spark, d), 40).where("label <> 1").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_KNNF}, t AS (SELECT * FROM kf ORDER BY round(distance, 9), vec_id LIMIT 30) SELECT vec_id, label, round(distance, 6) AS distance FROM t WHERE label = 1")
def knn_server(spark, d):
    """The nearest of all projects, then those of one."""
    return R.knn_float(table(spark, d, "embeddings"), _vector(spark, d), 30).where("label = 1").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_KNN8}, t AS (SELECT * FROM k8 ORDER BY round(raw, 9), vec_id LIMIT 30)
SELECT vec_id, round(1 - 0.85 * raw, 6) AS score FROM t WHERE 1 - 0.85 * raw >= 0.1 ORDER BY round(raw, 9), vec_id LIMIT 10""")
def flt_knn_post(spark, d):
    """Scores over a bound among a few more than asked for, then the limit."""
    hits = R.knn_int8(table(spark, d, "embeddings"), _vector(spark, d), 10 + 20).withColumn("score", 1 - F.col("distance"))
    return hits.where("score >= 0.1").orderBy(F.round("raw", 9), "vec_id").limit(10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH qf AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = {VEC_ID})
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 6) AS cosine FROM embeddings, qf""")
def vector_cosine(spark, d):
    q = R._literal(_vector(spark, d))
    return table(spark, d, "embeddings").select("vec_id", F.round(R.cosine(F.col("embedding"), q), 6).alias("cosine"))


_USABLE = """u AS (SELECT chunk_id, min(CAST(vector AS DOUBLE[])) AS emb FROM embed_vectors
  WHERE len(vector) = 64 AND NOT list_bool_or(list_transform(vector, lambda x: x IS NULL OR isnan(x))) GROUP BY chunk_id)"""


_FIFTIETH = "cast(conv(right(chunk_id, 8), 16, 10) as bigint) % 50 = 0"  # the stated query set


def _chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embed_vectors").where(F.size("vector") == 64).where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    return v.groupBy("chunk_id").agg(F.min("vector").alias("embedding"))


@query(f"""WITH {_USABLE}, p AS (SELECT a.chunk_id AS id_a, b.chunk_id AS id_b, 1 - list_distance(a.emb, b.emb) AS s FROM (SELECT * FROM u WHERE ('0x' || right(chunk_id, 8))::BIGINT % 50 = 0) a JOIN u b ON a.chunk_id <> b.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY round(1 - s, 9), id_b) AS place FROM p WHERE s >= 0.7)
SELECT id_a, id_b, round(s, 6) AS similarity, place FROM r WHERE place <= 5""")
def knn_conflicts(spark, d):
    """The nearest others within a bound, of every chunk whose (hexadecimal) id is divisible by 50, among all chunks."""
    v = cut(_chunk_vectors(spark, d))
    return R.conflicts(v.where(_FIFTIETH), v, 0.7, key="chunk_id").withColumn("similarity", F.round("similarity", 6))


_RRF_CODE = f"""{_DOC_BM}, {_KNN8},
lt AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS place FROM bm QUALIFY place <= 30),
lv AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(raw, 9), vec_id) AS place FROM k8 QUALIFY place <= 30),
f AS (SELECT doc_id, sum(1.0 / (60 + place)) AS score FROM (SELECT * FROM lt UNION ALL SELECT * FROM lv) GROUP BY doc_id)"""


@query(f"WITH {_RRF_CODE} SELECT doc_id, round(score, 6) AS score FROM f ORDER BY round(score, 12) DESC, doc_id LIMIT 10")
def rrf_hybrid_code(spark, d):
    return R.hybrid(table(spark, d, "documents"), _by_doc(spark, d), CODE_QUERY, _vector(spark, d), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {_NOTE_BM}, {_KNNF},
lt AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place FROM (SELECT * FROM bm WHERE coalesce(valid_at, created_at) <= 1760000000 AND (invalid_at IS NULL OR invalid_at > 1760000000)) QUALIFY place <= 45),
lv AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(distance, 9), vec_id) AS place FROM kf QUALIFY place <= 45),
lf AS (SELECT id, row_number() OVER (ORDER BY place) AS place FROM lv WHERE id IN (SELECT id FROM notes_v WHERE coalesce(valid_at, created_at) <= 1760000000 AND (invalid_at IS NULL OR invalid_at > 1760000000)))
SELECT id, round(sum(1.0 / (60 + place)), 6) AS score FROM (SELECT * FROM lt UNION ALL SELECT * FROM lf) GROUP BY id ORDER BY round(sum(1.0 / (60 + place)), 12) DESC, id LIMIT 15""")
def rrf_hybrid_memory(spark, d):
    """Phrase and vector hits of notes valid at an instant; the vectors' k is taken before the filter."""
    at, n = 1_760_000_000, 45
    valid = cut(R.as_of(V.notes(spark, d), at))
    text = R.as_of(R.fts_memory(V.notes(spark, d), NOTE_QUERY, limit=None), at).orderBy(F.desc(F.round("score", 9)), "id").limit(n)
    near = R.knn_float(table(spark, d, "embeddings"), _vector(spark, d), n).select(F.col("vec_id").alias("id"), "distance").join(valid.select("id"), "id", "left_semi")
    lists = [R.ranked(text, [F.desc(F.round("score", 9)), F.col("id")]), R.ranked(near, [F.round("distance", 9), F.col("id")])]
    return R.rrf(lists, "id", 15).withColumn("score", F.round("score", 6))


@query(f"""WITH {_KNNF}, t AS (SELECT * FROM kf ORDER BY round(distance, 9), vec_id LIMIT 50)
SELECT vec_id, round(1 - (distance - min(distance) OVER ()) / greatest(max(distance) OVER () - min(distance) OVER (), 1e-6), 6) AS similarity FROM t""")
def fn_min_max_norm(spark, d):
    hits = R.knn_float(table(spark, d, "embeddings"), _vector(spark, d), 50)
    return R.min_max_similarity(hits).select("vec_id", F.round("similarity", 6).alias("similarity"))


_PACK_SQL = """h AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rn, doc_id, greatest(1, n_chars // 4) AS tokens
  FROM bm JOIN documents USING (doc_id) QUALIFY rn <= 100),
g(rn, remaining, done, take, doc_id, tokens) AS (
  SELECT CAST(0 AS BIGINT), CAST({budget} AS BIGINT), false, false, CAST(NULL AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL SELECT h.rn, CASE WHEN NOT g.done AND g.remaining >= {stop} AND h.tokens <= g.remaining THEN g.remaining - h.tokens ELSE g.remaining END,
    g.done OR g.remaining < {stop}, NOT g.done AND g.remaining >= {stop} AND h.tokens <= g.remaining, h.doc_id, h.tokens FROM g JOIN h ON h.rn = g.rn + 1)
SELECT rn, doc_id, tokens FROM g WHERE take"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = R.fts_code(docs, CODE_QUERY, limit=100)
    one = R.ranked(hits, [F.desc(F.round("score", 9)), F.col("doc_id")]).withColumnRenamed("place", "rn")
    return one.join(docs.select("doc_id", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long").alias("tokens")), "doc_id").select("rn", F.col("doc_id"), "tokens")


@query(f"WITH RECURSIVE {_DOC_BM}, " + _PACK_SQL.format(budget=4000, stop=10))
def budget_pack(spark, d):
    return R.budget_pack(_hits(spark, d), 4000, ["rn"]).select(F.col("rn").cast("long").alias("rn"), "doc_id", "tokens")


_EST = "greatest(1, length(coalesce({0}, '')) // 4)"


@query("WITH RECURSIVE " + V.NOTES + f""", c AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC, id) AS place FROM notes_v WHERE status = 'active'),
h AS (SELECT *, row_number() OVER (ORDER BY prio, other, place, kind, ref) AS rn FROM (
  SELECT 'note' AS source, CAST(id AS VARCHAR) AS ref, kind, CASE kind WHEN 'decision' THEN 0 WHEN 'requirement' THEN 1 WHEN 'handoff' THEN 2 WHEN 'question' THEN 3 ELSE 4 END AS prio,
    CASE WHEN kind IN ('decision', 'requirement', 'handoff', 'question') THEN '' ELSE kind END AS other, place, {_EST.format('title')} + {_EST.format('body')} AS tokens
  FROM c WHERE place <= CASE kind WHEN 'handoff' THEN 3 WHEN 'question' THEN 10 WHEN 'decision' THEN 10 WHEN 'requirement' THEN 10 ELSE 20 END
  UNION ALL SELECT DISTINCT 'convention', 'texts in ' || lang, 'language', 5, '', 0, {_EST.format("'language'")} + {_EST.format("'texts in ' || lang")} FROM documents WHERE lang IS NOT NULL)),
g(rn, remaining, take, source, ref, kind, tokens) AS (SELECT CAST(0 AS BIGINT), CAST(1500 AS BIGINT), false, '', '', '', CAST(0 AS BIGINT)
  UNION ALL SELECT h.rn, CASE WHEN h.tokens <= g.remaining THEN g.remaining - h.tokens ELSE g.remaining END, h.tokens <= g.remaining, h.source, h.ref, h.kind, h.tokens FROM g JOIN h ON h.rn = g.rn + 1)
SELECT source, ref, kind, tokens FROM g WHERE take""")
def budget_pack_context(spark, d):
    """Sections by the priority of their kind, then conventions, in a token budget."""
    rules = table(spark, d, "documents").where("lang is not null").select(F.lit("language").alias("category"), F.concat(F.lit("texts in "), F.col("lang")).alias("description")).distinct()
    return R.context_pack(R.as_of(V.notes(spark, d), None), rules, 1500, {"handoff": 3, "question": 10, "decision": 10, "requirement": 10}, 20)


@query("WITH " + V.NOTES + """, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC, id) AS place FROM notes_v WHERE status = 'active')
SELECT id, kind, place FROM r WHERE place <= CASE kind WHEN 'handoff' THEN 3 WHEN 'question' THEN 10 WHEN 'decision' THEN 10 WHEN 'requirement' THEN 10 ELSE 20 END""")
def section_cap(spark, d):
    return R.section_cap(R.as_of(V.notes(spark, d), None), {"handoff": 3, "question": 10, "decision": 10, "requirement": 10}, 20).select("id", "kind", "place")


_PLACED = f"""{V.FILES}, {V.CHUNKS}, {_USABLE}, qv AS (SELECT emb FROM u WHERE chunk_id = (SELECT min(chunk_id) FROM u)),
near AS (SELECT f.project, f.path, c.start_line, c.end_line, c.chunk_id, list_distance(u.emb, qv.emb) AS distance FROM u JOIN chunks_v c USING (chunk_id) JOIN files_v f USING (file_id), qv),
got AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY round(distance, 9), chunk_id) AS rn FROM near WHERE project IN ('lantern', 'mossgate', 'tidepool')) WHERE rn <= 40)"""


@query(f"""WITH {_PLACED} SELECT project, chunk_id, path, start_line, end_line, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY path, start_line, end_line ORDER BY round(distance, 9), chunk_id) AS one FROM got) WHERE one = 1 ORDER BY round(distance, 9), chunk_id LIMIT 20""")
def multi_db_merge(spark, d):
    """A project and two it depends on: twice as many hits of each as asked for, the nearest of each place, then the limit."""
    v = cut(_chunk_vectors(spark, d))
    q = R._literal(v.orderBy("chunk_id").select("embedding").first().embedding)
    places = V.chunks(spark, d).select("chunk_id", "file_id", "start_line", "end_line").join(V.files(spark, d).select("file_id", "project", "path"), "file_id")
    hits = places.join(v, "chunk_id").select("project", "chunk_id", "path", "start_line", "end_line", R.l2(F.col("embedding"), q).alias("distance"))
    limit = 20
    fetch = max(2 * limit, limit + 10)
    parts = [hits.where(F.col("project") == p).orderBy(F.round("distance", 9), "chunk_id").limit(fetch) for p in ("lantern", "mossgate", "tidepool")]
    return R.merge_sources(parts, ["path", "start_line", "end_line"], "distance", limit, ["chunk_id"]).withColumn("distance", F.round("distance", 6))


@query("""SELECT source, auto, CASE WHEN embedded >= total THEN 'complete' WHEN embedded > 0 THEN 'partial' WHEN auto THEN 'zero_falls_back' ELSE 'zero_is_an_error' END AS coverage, embedded, total FROM (
  SELECT lower(trim(source)) AS source, count(*) AS total, count(e.vec_id) AS embedded FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id + 400 GROUP BY 1), (SELECT unnest([true, false]) AS auto)""")
def coverage_disposition(spark, d):
    """Both modes for each source."""
    docs = table(spark, d, "documents").select((F.col("doc_id") + 400).alias("doc_id"), F.lower(F.trim("source")).alias("source"))
    g = docs.join(_by_doc(spark, d).select("doc_id", F.lit(1).alias("has")), "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("has").alias("embedded"))
    both = g.withColumn("auto", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.select("source", "auto", R.coverage(F.col("embedded"), F.col("total"), F.col("auto")).alias("coverage"), "embedded", "total")


@query(f"""WITH RECURSIVE {_USABLE}, {V.CHUNKS}, x AS (SELECT chunk_id, emb, 'f' || (file_id // 2) AS ref, ('0x' || right(chunk_id, 8))::BIGINT % 50 = 0 AS asked FROM u JOIN chunks_v USING (chunk_id)),
k AS (SELECT *, row_number() OVER (ORDER BY chunk_id) AS rn FROM x WHERE asked),
near AS MATERIALIZED (SELECT k.rn, min(list_distance(k.emb, o.emb)) AS stored FROM k JOIN x o ON NOT o.asked GROUP BY k.rn),
g(rn, chunk_id, verdict, embs, refs) AS (SELECT CAST(0 AS BIGINT), '', '', CAST([] AS DOUBLE[][]), CAST([] AS VARCHAR[])
  UNION ALL SELECT rn, chunk_id, verdict, CASE WHEN verdict = 'stored' THEN list_append(embs, emb) ELSE embs END, CASE WHEN verdict = 'stored' THEN list_append(refs, ref) ELSE refs END FROM (
    SELECT k.rn, k.chunk_id, k.emb, k.ref, g.embs, g.refs, CASE WHEN list_contains(g.refs, k.ref) THEN 'harvested' WHEN n.stored < 0.6 OR list_min(list_transform(g.embs, lambda e: list_distance(e, k.emb))) < 0.6 THEN 'similar' ELSE 'stored' END AS verdict
    FROM g JOIN k ON k.rn = g.rn + 1 JOIN near n ON n.rn = k.rn))
SELECT chunk_id, verdict FROM g WHERE rn > 0""")
def harvest_semantic_dedup(spark, d):
    """Candidates (every chunk whose id is divisible by 50) one after the other against all other chunks and those taken in before."""
    v = cut(_chunk_vectors(spark, d).join(V.chunks(spark, d).select("chunk_id", F.concat(F.lit("f"), F.floor(F.col("file_id") / 2).cast("string")).alias("source_ref")), "chunk_id"))
    return H.harvested(v.where(_FIFTIETH), v.where(f"not ({_FIFTIETH})"), None, 0.6, "chunk_id").select("chunk_id", "verdict")


# --- symbol graph ----------------------------------------------------------------------------------------------------

_STRIP = r"""regexp_replace(regexp_replace(regexp_replace({0}, '(?s)/\*.*?\*/', ' ', 'g'), '"[^"\n]*"|''[^''\n]*''', '""', 'g'), '(//|#)[^\n]*', ' ', 'g')"""
_ANY_LANG = "CASE regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.]\\.([^.]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in (T.TEXT_LANGUAGES | T.LANGUAGES).items()) + " END"
_BY_LANG = f"CASE WHEN lang IS NULL OR lang IN ('php', 'hcl') THEN {_STRIP} WHEN lang IN ('python', 'ruby') THEN {_STRIP.replace('(//|#)', '#')} WHEN lang = 'sql' THEN {_STRIP.replace('(//|#)', '--')} ELSE {_STRIP.replace('(//|#)', '//')} END"
_BUILTIN = "(" + " OR ".join(f"(lang = '{g}' AND {{0}} IN ({', '.join(repr(x) for x in X.builtins_of(g))}))" for g in ("rust", "python", "javascript", "jsx", "typescript", "tsx", "go", "php", "ruby", "csharp", "kotlin", "swift", "c", "cpp")) + f" OR {{0}} IN ({', '.join(repr(x) for x in X.NOT_CALLED)}))"
_STOP = "[" + ", ".join(f"'{s}'" for s in G.STOP) + "]"
_MENTION = rf"""list_filter(list_distinct_ordered, lambda x: length(x) BETWEEN 3 AND 50 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains({_STOP}, x))[1:40]"""
_NAMED = V.FILES + ",\n" + V.CHUNKS + ",\nnamed AS (SELECT f.path, c.*, " + _ANY_LANG + " AS lang FROM chunks_v c JOIN files_v f USING (file_id))"
_TOKENS = rf"""bare AS MATERIALIZED (SELECT chunk_id, path, name, regexp_extract_all({_BY_LANG.format('content')}, '\w+') AS l FROM named),
tok AS (SELECT chunk_id, path, name, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM bare),
dist AS (SELECT chunk_id, path, name, t, min(pos) AS pos FROM tok GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, path, name ORDER BY pos) AS rn FROM dist
  WHERE length(t) BETWEEN 3 AND 50 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT list_contains({_STOP}, t)),
mt AS (SELECT * FROM kept WHERE rn <= 40)"""
_CALLS = rf"""calls AS (SELECT DISTINCT source_file, source_name, target_name FROM (
  SELECT path AS source_file, name AS source_name, lang, unnest(regexp_extract_all({_BY_LANG.format('content')}, '([A-Za-z_]\w*)\(', 1)) AS target_name FROM named WHERE name IS NOT NULL)
  WHERE NOT coalesce({_BUILTIN.format('target_name')}, false) AND target_name <> source_name)"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d).join(V.files(spark, d).select("file_id", "path"), "file_id")


@query(f"WITH {_NAMED}, {_TOKENS} SELECT chunk_id, path, count(*) AS n_tokens, string_agg(t, ',' ORDER BY rn) AS tokens FROM mt GROUP BY chunk_id, path")
def mention_tokens(spark, d):
    t = _named(spark, d).select("chunk_id", "path", G.mention_tokens(F.col("content"), language=T.lang_detect(F.col("path"))).alias("t")).where("size(t) > 0")
    return t.select("chunk_id", "path", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", ",").alias("tokens"))


@query(f"WITH {_NAMED}, {_TOKENS} SELECT path AS source_file, name AS source_name, t AS target_name, 'mentions' AS kind, 0 AS line FROM mt WHERE name IS NOT NULL")
def mention_edges(spark, d):
    return G.mention_edges(_named(spark, d))


@query(f"WITH {_NAMED}, {_CALLS} SELECT source_file, source_name, target_name, 'calls' AS kind FROM calls")
def edge_extract(spark, d):
    return G.call_edges(_named(spark, d)).select("source_file", "source_name", "target_name", "kind")


@query(rf"""WITH {_NAMED} SELECT lang, t AS name, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all({_BY_LANG.format('content')}, '([A-Za-z_]\w*)\(', 1)) AS t FROM named)
  WHERE {_BUILTIN.format('t')} GROUP BY lang, t""")
def edge_builtin_filter(spark, d):
    """Calls of built-ins, which make no edges, by language."""
    lang = T.lang_detect(F.col("path"))
    t = _named(spark, d).select(lang.alias("lang"), F.explode(F.regexp_extract_all(G.strip_comments(F.col("content"), lang), F.lit(r"([A-Za-z_]\w*)\("), 1)).alias("name"))
    return t.where(G.is_builtin(F.col("name"), F.col("lang"))).groupBy("lang", "name").agg(F.count(F.lit(1)).alias("n"))


@query()
def edge_scopes(spark, d):
    """Imports, base types, interfaces and calls of whole files with the definition around them."""
    return X.file_edges(V.file_texts(spark, d))


def _pattern_sql(kinds: tuple[str, ...]) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [f"SELECT path, {q(k)} AS kind, unnest(regexp_extract_all(text, {q(p)}, 1)) AS found FROM (SELECT *, {_ANY_LANG} AS lang FROM texts_v) WHERE lang = {q(g)}"
             for g in sorted({*X.EDGES, "jsx", "typescript", "tsx", "cpp"}) for k, p in X.edge_patterns(g) if k in kinds]
    return f"WITH {V.FILES},\n{V.CHUNKS},\n{V.TEXTS} SELECT DISTINCT path, kind, found FROM ({' UNION ALL '.join(parts)})"


@query(_pattern_sql(("imports",)))
def edge_imports(spark, d):
    """What the import lines of each file name, by the patterns of its language."""
    return X.pattern_edges(V.file_texts(spark, d), "imports").select("path", F.lit("imports").alias("kind"), "found").distinct()


@query(_pattern_sql(("extends", "implements")))
def edge_inherits(spark, d):
    """Base types and interfaces as they stand in the heads of types."""
    t = V.file_texts(spark, d)
    one = lambda k: X.pattern_edges(t, k).select("path", F.lit(k).alias("kind"), "found")
    return one("extends").union(one("implements")).distinct()


@query(r"""SELECT DISTINCT doc_id, trim(t) AS target_name FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(
  replace(replace(text, ' -> ', ' href="'), chr(10), '" '), '(?i)\b(?:src|href)\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1)), '^["'']|["'']$', '', 'g') AS t FROM documents)
  WHERE trim(t) <> '' AND trim(t) NOT LIKE '#%' AND trim(t) NOT LIKE 'data:%'""")
def edge_html(spark, d):
    """Attribute targets; the documents hold no HTML, so arrows are read as attributes to have some."""
    page = table(spark, d, "documents").select("doc_id", F.replace(F.replace("text", F.lit(" -> "), F.lit(' href="')), F.lit("\n"), F.lit('" ')).alias("text"))
    return G.html_edges(page).select("doc_id", "target_name").distinct()


@query("WITH " + V.EDGES + """, k AS (SELECT from_id, CASE WHEN kind IN ('imports', 'calls', 'extends', 'implements', 'mentions') THEN kind ELSE 'imports' END AS kind FROM edges_v)
SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def edge_kind_total(spark, d):
    return V.edges(spark, d).select(G.edge_kind(F.col("kind")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_NAMED}, {_CALLS}, s AS (SELECT DISTINCT source_name AS name FROM calls WHERE source_name LIKE 'scan%'),
nb AS (SELECT target_name AS name FROM calls WHERE source_name IN (SELECT name FROM s) UNION SELECT source_name FROM calls WHERE target_name IN (SELECT name FROM s))
SELECT DISTINCT chunk_id, name FROM named WHERE name IN (SELECT name FROM nb)""")
def join_graph_neighbors(spark, d):
    named = _named(spark, d)
    calls = G.call_edges(named)
    seeds = calls.where("source_name like 'scan%'").select(F.col("source_name").alias("name")).distinct()
    return named.join(G.neighbours(calls, seeds), "name", "left_semi").select("chunk_id", "name").distinct()


@query(f"""WITH {_NAMED}, {_TOKENS}, {_CALLS}, e AS (SELECT source_file, source_name, target_name, 'calls' AS kind FROM calls
  UNION ALL SELECT path, name, t, 'mentions' FROM mt WHERE name IS NOT NULL)
SELECT n.chunk_id, e.target_name, e.kind FROM named n JOIN e ON e.source_name = n.name AND e.source_file = n.path""")
def join_chunk_mentions(spark, d):
    named = _named(spark, d)
    e = G.call_edges(named).select("source_file", "source_name", "target_name", "kind").unionAll(G.mention_edges(named).select("source_file", "source_name", "target_name", "kind"))
    own = named.select("chunk_id", F.col("name").alias("source_name"), F.col("path").alias("source_file"))
    return own.join(e, ["source_name", "source_file"]).select("chunk_id", "target_name", "kind")


@query(f"""WITH {_NAMED}, {_TOKENS} SELECT t AS symbol, count(DISTINCT n.chunk_id) AS chunks FROM mt JOIN named n ON n.name = mt.name AND n.path = mt.path
  WHERE mt.name IS NOT NULL AND t LIKE '%ledger%' GROUP BY t""")
def join_symbol_chunks(spark, d):
    named = _named(spark, d)
    e = G.mention_edges(named).where("target_name like '%ledger%'").select("source_file", "source_name", F.col("target_name").alias("symbol"))
    own = named.select("chunk_id", F.col("name").alias("source_name"), F.col("path").alias("source_file"))
    return e.join(own, ["source_name", "source_file"]).groupBy("symbol").agg(F.countDistinct("chunk_id").alias("chunks"))


_GRAPH = V.EDGES + ",\ng AS MATERIALIZED (SELECT from_id AS src, to_id AS dst FROM edges_v)"


def _rank_sql(rounds: int, jump: str) -> str:
    """Unrolled rounds; jump is a relation (node, jump) over all nodes."""
    ctes = [f"""nodes AS MATERIALIZED (SELECT src AS node FROM g UNION SELECT dst FROM g), real AS MATERIALIZED (SELECT * FROM g WHERE src <> dst),
outd AS MATERIALIZED (SELECT src, count(*) AS o FROM real GROUP BY src), {jump}, r0 AS MATERIALIZED (SELECT node, 1.0 / (SELECT count(*) FROM nodes) AS rank FROM nodes)"""]
    for i in range(rounds):
        ctes.append(f"""r{i + 1} AS MATERIALIZED (SELECT j.node, (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM outd))) * j.jump
  + 0.85 * coalesce(x.got, 0) AS rank FROM j LEFT JOIN (SELECT dst, sum(rank / o) AS got FROM real JOIN r{i} ON r{i}.node = real.src JOIN outd ON outd.src = real.src GROUP BY dst) x ON x.dst = j.node)""")
    return ",\n".join(ctes)


@query(f"WITH {_GRAPH}, {_rank_sql(20, 'j AS MATERIALIZED (SELECT node, 1.0 / (SELECT count(*) FROM nodes) AS jump FROM nodes)')} SELECT node, round(rank, 6) AS rank FROM r20")
def pagerank(spark, d):
    e = V.edges(spark, d).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return G.pagerank(e).withColumn("rank", F.round("rank", 6))


@query(f"""WITH {_GRAPH}, {_rank_sql(20, "j AS MATERIALIZED (SELECT node, CASE WHEN node IN (SELECT id FROM notes WHERE kind = 'handoff') THEN 1.0 ELSE 0.0 END / (SELECT count(*) FROM nodes WHERE node IN (SELECT id FROM notes WHERE kind = 'handoff')) AS jump FROM nodes)")}
SELECT node, round(rank, 6) AS rank FROM r20""")
def ppr(spark, d):
    """Jumps to the handoff notes only."""
    e = V.edges(spark, d).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return G.pagerank(e, personal=nodes.join(table(spark, d, "notes").where("kind = 'handoff'").select(F.col("id").alias("node")), "node", "left_semi").withColumn("weight", F.lit(1.0))).withColumn("rank", F.round("rank", 6))


@query(f"""WITH {_GRAPH}, {_rank_sql(20, 'j AS MATERIALIZED (SELECT node, 1.0 / (SELECT count(*) FROM nodes) AS jump FROM nodes)')}, ids AS (SELECT DISTINCT id FROM notes)
SELECT id, round(coalesce(rank, 0.0), 6) AS graph_rank FROM ids LEFT JOIN r20 ON node = id""")
def pagerank_to_chunks(spark, d):
    """Ranks carried to their rows; a row outside the graph keeps the rank it had (0 here)."""
    e = V.edges(spark, d).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    ids = table(spark, d, "notes").select("id").distinct()
    return ids.join(G.pagerank(e).withColumnRenamed("node", "id"), "id", "left").select("id", F.round(F.coalesce("rank", F.lit(0.0)), 6).alias("graph_rank"))


_RAG = rf"""{_RRF_CODE.replace("place <= 30", "place <= 150")}, pd AS (SELECT doc_id, 1 / score AS distance FROM f ORDER BY round(score, 12) DESC, doc_id LIMIT 50),
pool AS MATERIALIZED (SELECT doc_id AS chunk, 1 - (distance - min(distance) OVER ()) / greatest(max(distance) OVER () - min(distance) OVER (), 1e-6) AS similarity FROM pd),
dt AS (SELECT doc_id, t, min(pos) AS pos FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (
  SELECT doc_id, regexp_extract_all({_STRIP.format('text')}, '\w+') AS l FROM documents)) GROUP BY ALL),
ment AS MATERIALIZED (SELECT doc_id AS chunk, t AS symbol FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM dt
  WHERE length(t) BETWEEN 3 AND 50 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT list_contains({_STOP}, t)) WHERE rn <= 40),
best AS MATERIALIZED (SELECT * FROM (SELECT symbol, max(similarity) AS heat FROM ment JOIN pool USING (chunk) GROUP BY symbol) WHERE heat > 0.25 ORDER BY round(heat, 9) DESC, symbol LIMIT 150),
own AS (SELECT chunk, symbol FROM ment WHERE chunk IN (SELECT chunk FROM pool) AND symbol IN (SELECT symbol FROM best)),
wide AS MATERIALIZED (SELECT chunk, symbol, heat FROM ment JOIN best USING (symbol) WHERE chunk NOT IN (SELECT chunk FROM pool)),
fresh AS MATERIALIZED (SELECT chunk FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY chunk) AS p FROM wide) WHERE p <= 50 GROUP BY chunk ORDER BY round(max(heat), 9) DESC, chunk LIMIT 500),
bag AS (SELECT * FROM own UNION ALL SELECT * FROM own UNION ALL SELECT chunk, symbol FROM wide WHERE chunk IN (SELECT chunk FROM fresh)),
g AS MATERIALIZED (SELECT 'c:' || chunk AS src, 's:' || symbol AS dst FROM bag UNION ALL SELECT 's:' || symbol, 'c:' || chunk FROM bag),
st AS (SELECT 'c:' || chunk AS node, similarity AS w FROM pool UNION ALL SELECT 's:' || symbol, heat FROM best)"""


@query(f"""WITH {_RAG}, {_rank_sql(20, "j AS MATERIALIZED (SELECT node, coalesce(w, 0) / (SELECT sum(w) FROM st) AS jump FROM nodes LEFT JOIN st USING (node))")},
m AS (SELECT chunk, similarity FROM pool UNION ALL SELECT chunk, 0 FROM fresh)
SELECT chunk AS doc_id, round(0.5 * similarity + 0.5 * coalesce(rank, 0) / (SELECT max(rank) FROM r20 WHERE node LIKE 'c:%'), 6) AS score
FROM m LEFT JOIN r20 ON node = 'c:' || chunk ORDER BY round(0.5 * similarity + 0.5 * coalesce(rank, 0) / (SELECT max(rank) FROM r20 WHERE node LIKE 'c:%'), 9) DESC, chunk LIMIT 10""")
def linearrag(spark, d):
    """Hybrid pool, symbol activation, expansion and personalised PageRank over documents and the words they hold."""
    docs = table(spark, d, "documents")
    hits = R.hybrid(docs, _by_doc(spark, d), CODE_QUERY, _vector(spark, d), 50).withColumn("distance", 1 / F.col("score"))
    pool = cut(R.min_max_similarity(hits).select(F.col("doc_id").alias("chunk"), "similarity"))
    mentions = lambda rows: rows.select(F.col("doc_id").alias("chunk"), F.explode(G.mention_tokens(F.col("text"))).alias("symbol"))
    near = docs.join(F.broadcast(pool.select(F.col("chunk").alias("doc_id"))), "doc_id")  # fifty rows
    ranked = G.linear_rag(pool, mentions(spread(docs.select("doc_id", "text"), "doc_id")), 10, pool_mentions=mentions(near))
    return ranked.select(F.col("chunk").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""WITH {_NAMED}, {_CALLS}, r AS (SELECT DISTINCT chunk_id FROM named WHERE name LIKE 'fold_ledger%'), s AS (SELECT DISTINCT name FROM named WHERE chunk_id IN (SELECT chunk_id FROM r)),
nb AS (SELECT target_name AS name FROM calls WHERE source_name IN (SELECT name FROM s) UNION SELECT source_name FROM calls WHERE target_name IN (SELECT name FROM s))
SELECT DISTINCT chunk_id, true AS from_graph FROM named WHERE name IN (SELECT name FROM nb) AND chunk_id NOT IN (SELECT chunk_id FROM r) ORDER BY chunk_id LIMIT 15""")
def graph_expand(spark, d):
    """One-hop neighbours of a result that are not in it."""
    named = _named(spark, d)
    result = named.where("name like 'fold_ledger%'")
    near = named.join(G.neighbours(G.call_edges(named), result.select("name").distinct()), "name", "left_semi").select("chunk_id").distinct()
    return near.join(result.select("chunk_id"), "chunk_id", "left_anti").orderBy("chunk_id").limit(15).withColumn("from_graph", F.lit(True))


@query("SELECT vec_id, 4 * len(embedding) AS n_bytes, true AS same FROM embeddings")
def blob_codec(spark, d):
    """Vectors as little-endian 32-bit floats and back."""
    from cairnset.functions.vector import decode_floats, encode_floats

    e = cut(table(spark, d, "embeddings").select("vec_id", "embedding", encode_floats(F.col("embedding")).alias("b")))
    return e.select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), (decode_floats(F.col("b")) == F.col("embedding")).alias("same"))


@query(f"WITH {_DOC_BM} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 50")
def fts_index(spark, d):
    """The same search from a stored inverted index (built here first; a store keeps it)."""
    from cairnset.operators.index import search_index, write_index
    from cairnset.streaming.streams import shared_folder

    folder = shared_folder(spark, "index")
    write_index(table(spark, d, "documents"), folder)
    return search_index(spark, folder, CODE_QUERY, limit=50).withColumn("score", F.round("score", 6))
