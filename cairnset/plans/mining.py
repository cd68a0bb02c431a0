"""Sources, chunkers, scalar functions, conventions and metrics as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnset.functions import harvest as H
from cairnset.functions import metrics as M
from cairnset.functions import text as T
from cairnset.operators import chunking as C
from cairnset.operators import conventions as V2
from cairnset.operators import retrieval as R
from cairnset.operators import syntax as X2
from cairnset.plans import views as V
from cairnset.plans.ranked import CODE_QUERY, _DOC_BM
from cairnset.plans.registry import registry
from cairnset.session import table
from cairnset.sources import export as X
from cairnset.sources import files as S

QUERIES, ORACLE, query = registry()
w = V.with_views
q1 = lambda s: "'" + s.replace("'", "''") + "'"


# --- sources ---------------------------------------------------------------------------------------------------------


def _rules_sql(path: str) -> str:
    """Last rule that matches wins."""
    cases = " ".join(f"WHEN regexp_matches({path}, {q1(rx)}) THEN {q1('keep' if keep else pattern)}" for pattern, rx, keep in reversed(S.compile_rules(S.DEFAULT_EXCLUDES + ["!src/generators/"])))
    return f"CASE {cases} ELSE 'keep' END"


@query(w(V.FILES, then=f"""SELECT file_id, path, coalesce(list_filter(list_transform(range(1, len(s) + 1), lambda i: {_rules_sql("(array_to_string(s[1:i], '/') || CASE WHEN i < len(s) THEN '/' ELSE '' END)")}), lambda x: x <> 'keep')[1], 'keep') AS decision
FROM (SELECT file_id, path, string_split(path, '/') AS s FROM files_v WHERE path IS NOT NULL)"""))
def src_index_filter(spark, d):
    f = V.files(spark, d).where("path is not null")
    return f.select("file_id", "path", S.decide(F.col("path"), S.DEFAULT_EXCLUDES + ["!src/generators/"]).alias("decision"))


@query(w(V.FILES, then=rf"""SELECT file_id, path FROM files_v WHERE NOT regexp_matches(lower(path), {q1(S.SENSITIVE)}) AND regexp_matches(regexp_replace(path, '^.*/', ''), '[^.]\.[^.]+$')"""))
def src_file_walk(spark, d):
    """Paths a walk would keep: nothing sensitive, only recognised kinds."""
    return V.files(spark, d).where(S.walkable(F.col("path"))).select("file_id", "path")


@query(r"""SELECT chunk_id, CASE WHEN len(list_filter(h, lambda x: contains(x, '@generated'))) > 0 THEN '@generated'
WHEN len(list_filter(h, lambda x: regexp_matches(rtrim(x), '^// Code generated by .* DO NOT EDIT\.$'))) > 0 THEN 'Code generated' END AS mark
FROM (SELECT DISTINCT chunk_id, string_split(left(content, 4096), chr(10))[1:5] AS h FROM embed_chunks WHERE seq = 0)""")
def src_generated_marker(spark, d):
    c = table(spark, d, "embed_chunks").where("seq = 0").select("chunk_id", "content").distinct()
    return c.select("chunk_id", T.generated_marker(F.col("content")).alias("mark"))


@query("SELECT doc_id, contains(left(text, 512), chr(0)) AS is_binary, CASE WHEN n > 67108864 THEN 'skip' WHEN n > 524288 THEN 'windows' ELSE 'parse' END AS gate FROM (SELECT *, strlen(text) * 2048 AS n FROM documents)")
def src_size_gate(spark, d):
    """Texts that are binary, too large to read, or so large that they are cut by windows only (each counted as 2,048 copies of itself)."""
    return table(spark, d, "documents").select("doc_id", T.is_binary(F.col("text")).alias("is_binary"), S.size_gate(F.octet_length("text").cast("long") * 2048).alias("gate"))


@query("SELECT count(*) FILTER (contains(left(text, 512), chr(0))) AS n_binary, count(*) AS n FROM documents")
def src_binary_probe(spark, d):
    return table(spark, d, "documents").agg(F.count(F.when(T.is_binary(F.col("text")), 1)).alias("n_binary"), F.count(F.lit(1)).alias("n"))


_LANG = "CASE regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.]\\.([^.]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in (T.TEXT_LANGUAGES | T.LANGUAGES).items()) + " END"


@query(w(V.FILES, then=f"SELECT file_id, {_LANG} AS language FROM files_v"))
def src_lang_detect(spark, d):
    return V.files(spark, d).select("file_id", T.lang_detect(F.col("path")).alias("language"))


@query("SELECT count(*) + 0 AS objects, 2 * count(*) AS skipped FROM (SELECT DISTINCT id FROM notes)")
def src_jsonl_log(spark, d):
    """A JSON-lines log with blank and broken lines between the records."""
    n = table(spark, d, "notes").select("id", "kind", "title").distinct().withColumn("schema_version", F.lit(1))
    lines = n.select(F.explode(F.array(F.to_json(F.struct("*")), F.lit(" "), F.lit("[1, 2]"))).alias("value"))
    good = X.read_log(lines)
    return lines.agg(F.count(F.lit(1)).alias("n")).crossJoin(good.agg(F.count(F.lit(1)).alias("objects"))).select("objects", (F.col("n") - F.col("objects")).alias("skipped"))  # single rows


@query(r"""SELECT doc_id, string_split(text, chr(10))[1] AS subject, length(regexp_replace(text, '^[^\n]*\n*', '')) AS body_chars FROM documents WHERE {_SOURCE} = 'commit_messages'""".replace("{_SOURCE}", V.SOURCE))
def src_git_log(spark, d):
    m = table(spark, d, "documents").where(T.source_name(F.col("source")) == "commit_messages")
    log = m.select("doc_id", F.concat_ws("\0", F.col("doc_id").cast("string"), F.substring_index("text", "\n", 1), F.regexp_replace("text", r"^[^\n]*\n*", ""), F.lit("---")).alias("value"))
    return X.parse_git_log(log).select(F.col("sha").cast("long").alias("doc_id"), "subject", F.char_length("body").alias("body_chars"))


@query("""SELECT 's' || user_id AS session, count(*) AS turns, min((epoch_us(ts) // 1000)) AS first_at, md5(string_agg(props, '|' ORDER BY (epoch_us(ts) // 1000), props)) AS texts, (SELECT count(*) FILTER (event_type = 'error') FROM events) AS errors
FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type IN ('click', 'view') GROUP BY user_id""")
def src_history_jsonl(spark, d):
    """Session history as JSON lines, with broken lines between, since an instant and under a project prefix, by session."""
    e = table(spark, d, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    project = F.concat(F.when(F.col("event_type").isin("click", "view"), "/work/a/").otherwise("/work/b/"), "event_type")
    line = F.to_json(F.struct(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sessionId"), project.alias("project"), at.alias("timestamp"), F.col("props").alias("display")))
    lines = e.select(F.explode(F.array(line, F.when(F.col("event_type") == "error", "{broken").otherwise(" "))).alias("value"))
    sessions, errors = X.read_history(lines, 1_704_844_800_000, "/work/a/")
    return sessions.crossJoin(F.broadcast(errors)).select("session", "turns", "first_at", F.md5(F.array_join("texts", "|")).alias("texts"), "errors")  # one row


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation")
def sink_jsonl(spark, d):
    return table(spark, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("line"))


_DUMP = """rec AS (SELECT 'note' AS kind, CAST(id AS VARCHAR) AS ref, sha256(id || '|' || title) AS digest FROM (SELECT DISTINCT id, title FROM notes)),
rel AS (SELECT from_id || '>' || to_id || ':' || kind AS ref, sha256(from_id || '>' || to_id || ':' || kind) AS digest FROM edges_v WHERE from_id IN (SELECT id FROM notes) AND to_id IN (SELECT id FROM notes))"""


def _records(spark, d):
    ids = table(spark, d, "notes").select("id").distinct()
    n = table(spark, d, "notes").select("id", "title").distinct()
    rel = X.relationships(V.edges(spark, d), ids)
    entities = n.select(F.lit("note").alias("kind"), F.col("id").cast("string").alias("ref"), F.concat_ws("|", F.col("id").cast("string"), "title").alias("payload"))
    link = F.concat(F.col("from_id").cast("string"), F.lit(">"), F.col("to_id").cast("string"), F.lit(":"), F.col("kind"))
    return entities.unionByName(rel.select(F.lit("relationship").alias("kind"), link.alias("ref"), link.alias("payload")))


@query(w(V.EDGES, _DUMP, then="""SELECT 'note' AS kind, count(*) AS n, sha256(string_agg(digest, '' ORDER BY ref)) AS digest FROM rec UNION ALL SELECT 'relationship', count(*), sha256(string_agg(digest, '' ORDER BY ref)) FROM rel"""))
def sink_export_dump(spark, d):
    """Footer of a dump: count and digest of each kind (each kind sorted and streamed through one hash)."""
    return X.footer(_records(spark, d))


@query(w(V.EDGES, _DUMP, then="SELECT (SELECT count(*) FROM rec) + (SELECT count(*) FROM rel) AS records, 0 AS duplicates, 0 AS dangling"))
def sink_export_verify(spark, d):
    return X.verify(_records(spark, d), V.edges(spark, d).join(table(spark, d, "notes").select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi").join(table(spark, d, "notes").select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi"), table(spark, d, "notes").select("id"))


@query("SELECT 'files' AS store, count(*) AS n FROM files UNION ALL SELECT 'notes', count(*) FROM notes UNION ALL SELECT 'memory_edges', count(*) FROM memory_edges UNION ALL SELECT 'embed_chunks', count(*) FROM embed_chunks")
def sink_export_inventory(spark, d):
    return X.inventory({n: table(spark, d, n) for n in ("files", "notes", "memory_edges", "embed_chunks")})


@query(w(V.EDGES, then="""SELECT from_id, to_id, kind, created_at FROM edges_v WHERE from_id IN (SELECT id FROM notes) AND to_id IN (SELECT id FROM notes)"""))
def src_export_extract(spark, d):
    return X.relationships(V.edges(spark, d), table(spark, d, "notes").select("id").distinct()).select("from_id", "to_id", "kind", "created_at")


@query(w(V.EDGES, then="SELECT from_id, to_id, kind FROM edges_v WHERE from_id NOT IN (SELECT id FROM notes) OR to_id NOT IN (SELECT id FROM notes)"))
def src_export_dropped(spark, d):
    """The warnings of the same: edges with an end that is not there."""
    return X.dangling(V.edges(spark, d), table(spark, d, "notes").select("id")).select("from_id", "to_id", "kind")


# --- chunkers --------------------------------------------------------------------------------------------------------

_LINES = """ln AS (SELECT doc_id, list_transform(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, lambda x: regexp_replace(x, '\\r$', '')) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
su AS (SELECT doc_id, l, list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x) + 1))) AS s FROM ln WHERE len(l) > 0)"""


@query(f"""WITH RECURSIVE {_LINES}, win(doc_id, l, s, a, b) AS (
  SELECT doc_id, l, s, 1, greatest(1, len(list_filter(s, lambda x: x - 1 <= 2048))) FROM su
  UNION ALL SELECT doc_id, l, s, n, greatest(n, len(list_filter(s, lambda x: x - s[n - 1] - 1 <= 2048))) FROM (
    SELECT doc_id, l, s, greatest(a + 1, CASE WHEN s[b] <= 256 THEN 1 ELSE len(list_filter(s, lambda x: x < s[b] - 256)) + 2 END) AS n FROM win WHERE b < len(l)))
SELECT doc_id, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, length(array_to_string(l[a:b], chr(10))) AS n_chars FROM win""")
def chunk_sliding_window(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(C.sliding_window(F.col("text"))).alias("w"))
    return x.select("doc_id", "w.start_line", "w.end_line", F.char_length("w.content").alias("n_chars"))


@query("""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) AS x FROM documents)),
h AS (SELECT *, regexp_matches(line, '^#{1,6}( |$)') AS head, sum(CASE WHEN regexp_matches(line, '^#{1,6}( |$)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM l)
SELECT doc_id, min(n) AS start_line, max(n) AS end_line, CASE WHEN bool_or(head) THEN trim(regexp_replace(first(line ORDER BY n), '^#{1,6}', '')) END AS name, sum(length(line) + 1)::BIGINT - 1 AS n_chars
FROM h GROUP BY doc_id, sec HAVING bool_or(regexp_matches(line, '\\S'))""")
def chunk_markdown(spark, d):
    s = C.markdown_sections(table(spark, d, "documents"))
    return s.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "name", F.char_length("content").cast("long").alias("n_chars"))


@query()
def chunk_markdown_windows(spark, d):
    """Sections with those over the cap cut into windows."""
    return C.markdown_chunks(table(spark, d, "documents")).select("doc_id", "start_line", "end_line", "name", "kind")


@query(r"""WITH c AS (SELECT doc_id, 1 AS n, string_split(text, chr(10))[1] AS content FROM documents UNION ALL SELECT doc_id, 2, text FROM documents),
k AS (SELECT *, greatest(1, len(string_split(regexp_replace(content, '\n$', ''), chr(10)))) AS lines FROM c WHERE regexp_matches(content, '\S')),
s AS (SELECT *, coalesce(sum(lines) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, 'cell ' || n AS name, CAST(before + 1 AS INTEGER) AS start_line, CAST(before + lines AS INTEGER) AS end_line, CASE n WHEN 1 THEN 'section' ELSE 'verbatim' END AS kind, CASE n WHEN 1 THEN 'markdown' ELSE 'python' END AS language FROM s""")
def chunk_notebook(spark, d):
    """Documents wrapped as notebooks of two cells each."""
    cell = lambda k, c: F.struct(F.lit(k).alias("cell_type"), c.alias("source"))
    nb = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.array(cell("markdown", F.substring_index("text", "\n", 1)), cell("code", F.col("text"))).alias("cells"))).alias("text"))
    return C.notebook_cells(nb).select("doc_id", "name", "start_line", "end_line", "kind", "language")


@query()
def chunk_ast(spark, d):
    """Whole files cut at the definitions of their language; the rest in line windows."""
    return X2.file_chunks(V.file_texts(spark, d)).select("file_id", "kind", "name", "parent_scope", "start_line", "end_line", F.char_length("content").alias("n_chars"), "docstring")


@query()
def chunk_python_tree(spark, d):
    """Definitions of the Python chunks by their syntax tree."""
    c = V.chunks(spark, d).join(V.files(spark, d).where("lower(path) like '%.py'").select("file_id"), "file_id", "left_semi")
    return C.python_definitions(c, key="chunk_id", text="content")


@query(w(V.CHUNKS, then="SELECT chunk_id, name FROM chunks_v"))
def chunk_name_extract(spark, d):
    return V.chunks(spark, d).select("chunk_id", "name")


@query(r"SELECT DISTINCT chunk_id, nullif(regexp_extract(content, '^\s*(?:///?|#+|/\*+)\s*([^\n]*?)\s*(?:\*/)?\s*(?:\n|$)', 1), '') AS docstring FROM embed_chunks")
def chunk_docstring(spark, d):
    """The comment a chunk opens with."""
    return table(spark, d, "embed_chunks").select("chunk_id", F.nullif(F.regexp_extract("content", r"^\s*(?:///?|#+|/\*+)\s*([^\n]*?)\s*(?:\*/)?\s*(?:\n|$)", 1), F.lit("")).alias("docstring")).distinct()


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents")
def tok_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tok_estimate(F.col("text")).alias("tokens"))


@query(w(V.CHUNKS, then="SELECT chunk_id, CAST(CASE WHEN coalesce(token_count, 0) = 0 THEN greatest(1, length(content) // 4) ELSE token_count END AS INTEGER) AS tokens FROM chunks_v"))
def tok_backfill(spark, d):
    return V.chunks(spark, d).select("chunk_id", F.when(F.coalesce("token_count", F.lit(0)) == 0, T.tok_estimate(F.col("content"))).otherwise(F.col("token_count")).alias("tokens"))


@query(w(V.CHUNKS, then="SELECT chunk_id, 'title: ' || coalesce(name, 'none') || ' | text: ' || content AS t FROM chunks_v"))
def chunk_embedding_text(spark, d):
    none = F.lit(None).cast("string")
    return V.chunks(spark, d).select("chunk_id", T.embedding_text(F.col("name"), none, none, F.col("content")).alias("t"))


_SECRET = "regexp_matches(content, " + q1("|".join(f"(?:{p})" for p in T.SECRET_PATTERNS)) + ")"


@query(w(V.CHUNKS, then=f"SELECT chunk_id FROM chunks_v WHERE NOT coalesce({_SECRET}, false)"))
def chunk_secret_drop(spark, d):
    return V.chunks(spark, d).where(~T.has_secret(F.col("content"))).select("chunk_id")


@query(w(V.CHUNKS, then="""SELECT chunk_id, CASE WHEN strlen(content) <= 1500 THEN content ELSE content[1:list_max(list_filter(range(375, 1501), lambda n: strlen(content[1:n]) <= 1500))] END AS asked
FROM chunks_v WHERE content IS NOT NULL"""))
def chunk_summarise(spark, d):
    """The text a summary would be asked for: at most 1,500 bytes, cut between characters."""
    return V.chunks(spark, d).where("content is not null").select("chunk_id", T.truncate_bytes(F.col("content"), 1500).alias("asked"))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, line, CASE WHEN regexp_matches(line, '^#{1,6}( |$)') THEN trim(regexp_replace(line, '^#{1,6}', '')) END AS title FROM (SELECT doc_id, unnest(CASE WHEN text IS NULL THEN [NULL] ELSE string_split(text, chr(10)) END) AS line FROM documents)""")
def fn_atx_heading(spark, d):
    """Every line of every document."""
    x = table(spark, d, "documents").select("doc_id", F.explode_outer(F.split("text", "\n")).alias("line"))
    return x.withColumn("title", T.atx_heading(F.col("line")))


@query("SELECT doc_id, text AS clean FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS text FROM documents)")
def fn_strip_ansi(spark, d):
    """Terminal sequences put into the whole texts and taken out again."""
    dirty = F.concat(F.lit("\x1b[31m\x1b]0;t\x07"), F.col("text"), F.lit("\x1b[0m\x07"))
    return table(spark, d, "documents").select("doc_id", T.strip_ansi(dirty).alias("clean"))


@query(r"SELECT file_id, replace(path, '\', '/') AS path FROM files")
def fn_normalize_path(spark, d):
    return table(spark, d, "files").select("file_id", T.normalize_path(F.col("path")).alias("path"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' ') AS plain
FROM (SELECT doc_id, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS t FROM documents)""")
def fn_html_unescape(spark, d):
    """Whole texts, escaped and unescaped again."""
    t = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return table(spark, d, "documents").select("doc_id", T.html_unescape(t).alias("plain"))


@query(r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?:^|\n)# ([^\n]+)', 1), ''), coalesce(path, 'none')) AS title FROM documents")
def fn_web_title(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.regexp_extract("text", r"(?:^|\n)# ([^\n]+)", 1), F.lit("")), F.coalesce("path", F.lit("none"))).alias("title"))


@query(w(V.NOTES, then="""SELECT id, CASE WHEN s < 90 THEN s || ' sec ago' WHEN s < 3600 THEN s // 60 || ' min ago' WHEN s < 86400 THEN s // 3600 || ' hr ago' ELSE s // 86400 || ' days ago' END AS age
FROM (SELECT id, greatest(0, 1765000000 - created_at) AS s FROM notes_v)"""))
def fn_format_age(spark, d):
    return V.notes(spark, d, "id").select("id", T.format_age(F.lit(1765000000) - F.col("created_at")).alias("age"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS day, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS from_date, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) + 36000 AS from_time FROM orders")
def fn_parse_as_of(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("day")).distinct()
    return o.select("day", T.parse_as_of(F.col("day")).alias("from_date"), T.parse_as_of(F.concat("day", F.lit("T10:00Z"))).alias("from_time"))


@query(w(V.FILES, V.CHUNKS, V.TEXTS, then="SELECT file_id, sha256(text) AS hash, sha256(text) IS DISTINCT FROM CASE WHEN mtime > 0 THEN sha256(text) ELSE hash END AS stale FROM texts_v JOIN files_v USING (file_id)"))
def fn_blake3_stale(spark, d):
    """A stable content hash of each file against the stored one (any will do; Spark has SHA-256). Files with a time count as stored with it."""
    t = V.file_texts(spark, d).select("file_id", F.sha2("text", 256).alias("now")).join(V.files(spark, d).select("file_id", "hash", "mtime"), "file_id")
    stored = F.when(F.col("mtime") > 0, F.col("now")).otherwise(F.col("hash"))
    return t.select("file_id", F.col("now").alias("hash"), (~F.col("now").eqNullSafe(stored)).alias("stale"))


@query(w(V.NOTES, then="SELECT id, substr(list_filter(list_concat(tags, ['git:' || coalesce(source_ref, 'none')]), lambda x: starts_with(x, 'git:'))[1], 5) AS sha FROM notes_v WHERE tags IS NOT NULL"))
def fn_source_commit(spark, d):
    n = V.notes(spark, d).where("tags is not null")
    tags = F.concat("tags", F.array(F.concat(F.lit("git:"), F.coalesce("source_ref", F.lit("none")))))
    first = F.try_element_at(F.filter(tags, lambda t: t.startswith("git:")), F.lit(1))
    return n.select("id", F.regexp_replace(first, "^git:", "").alias("sha"))


def _edges_of_words(p: str) -> str:
    """Word boundaries of any script, spelled out."""
    parts = p.split(r"\b")
    return "".join(x + ("" if i + 1 == len(parts) else r"(?:^|[^\p{L}\p{M}\p{N}_])" if i % 2 == 0 else r"(?:$|[^\p{L}\p{M}\p{N}_])") for i, x in enumerate(parts))


_INJ = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({c}, {q1(_edges_of_words(p))}) THEN '{f}:{cat}' END" for cat, p in T.INJECTION_PATTERNS for f, c in (("title", "path"), ("body", "text"))) + ")"


@query(f"SELECT doc_id, {_INJ} AS found FROM documents WHERE {_INJ} IS NOT NULL")
def fn_injection_scan(spark, d):
    x = table(spark, d, "documents").select("doc_id", T.injection_category(F.col("path"), F.col("text")).alias("found"))
    return x.where("found is not null")


@query("""WITH t AS (SELECT user_id, string_agg(event_type, chr(10) || chr(10) ORDER BY event_id) AS x FROM events GROUP BY user_id) SELECT user_id, strlen(CASE WHEN strlen(x) <= 400 THEN x ELSE left(x, 400) || ' [cut]' END) AS bytes FROM t""")
def fn_session_cap(spark, d):
    """A session's turns in order, capped by bytes between characters, with a mark where cut."""
    capped = H.capped_sessions(table(spark, d, "events"), "user_id", "event_id", "event_type", 400, " [cut]")
    return capped.select("user_id", F.octet_length("text").cast("long").alias("bytes"))


@query("""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), r(user_id, rn, rate) AS (
  SELECT user_id, rn, value FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.rn = 2 THEN 0.1 * r.rate + 0.9 * e.value ELSE (r.rate + e.value) / 2 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, round(arg_max(rate, rn), 4) AS rate FROM r GROUP BY user_id""".replace("WITH e", "WITH RECURSIVE e"))
def fn_rate_ewma(spark, d):
    """First sample seeds, the second takes nine tenths, later ones half."""
    return H.moving_rate(table(spark, d, "events"), "user_id", "event_id", "value").withColumn("rate", F.round("rate", 4))


# --- conventions -----------------------------------------------------------------------------------------------------

_CONV = V.FILES + ",\n" + V.CHUNKS + f""",
cc AS (SELECT CASE WHEN l = 'tsx' THEN 'typescript' ELSE l END AS language, node_type, name, content, path FROM (SELECT {_LANG} AS l, path, c.* FROM chunks_v c JOIN files_v USING (file_id)) WHERE l IS NOT NULL),
st AS (SELECT *, CASE WHEN strlen(name) < 3 THEN NULL WHEN regexp_matches(name, '\\p{{Lu}}') AND NOT regexp_matches(name, '\\p{{Ll}}') AND contains(name, '_') THEN 'SCREAMING_SNAKE_CASE'
  WHEN regexp_matches(name, '^\\p{{Lu}}') AND NOT contains(name, '_') THEN 'PascalCase' WHEN NOT regexp_matches(name, '^\\p{{Lu}}') AND regexp_matches(name, '\\p{{Lu}}') AND NOT contains(name, '_') THEN 'camelCase'
  WHEN regexp_matches(name, '\\p{{Ll}}') AND NOT regexp_matches(name, '\\p{{Lu}}') THEN 'snake_case' END AS style, node_type IN ('function', 'method') AS is_call,
  coalesce(regexp_matches(regexp_replace(content, '^\\s+', ''), '^(///|//!|/\\*\\*|/\\*!|\"\"\"|''''''|\\* )'), false) AS doc FROM cc),
nm AS (SELECT language, style, count(*) AS n, sum(count(*)) OVER (PARTITION BY language) AS total,
  row_number() OVER (PARTITION BY language ORDER BY count(*) DESC, CASE style WHEN 'snake_case' THEN 0 WHEN 'camelCase' THEN 1 WHEN 'PascalCase' THEN 2 ELSE 3 END) AS rn FROM st WHERE is_call AND style IS NOT NULL GROUP BY language, style),
dc AS (SELECT language, count(*) AS n, count(*) FILTER (doc) / count(*) AS r FROM st WHERE is_call GROUP BY language)"""


def _conv_chunks(spark, d):
    c = V.chunks(spark, d).join(V.files(spark, d).select("file_id", "path"), "file_id")
    return c.select(T.lang_detect(F.col("path")).alias("language"), "node_type", "name", "content", "path")


def _conv(spark, d, category):
    r = V2.records(V2.language_counts(_conv_chunks(spark, d))).where((F.col("category") == category) & (F.col("source") == 1))
    return r.select("language", "description", F.round("confidence", 6).alias("confidence"), "evidence_count")


@query("WITH " + _CONV + " SELECT name, min(style) AS style, count(*) AS n FROM st WHERE name IS NOT NULL GROUP BY name")
def conv_case(spark, d):
    n = _conv_chunks(spark, d).where("name is not null and language is not null")
    return n.groupBy("name").agg(F.min(T.case_style(F.col("name"))).alias("style"), F.count(F.lit(1)).alias("n"))


@query("WITH " + _CONV + " SELECT language, 'Functions use ' || style AS description, round(n / total, 6) AS confidence, n AS evidence_count FROM nm WHERE rn = 1")
def conv_naming(spark, d):
    return _conv(spark, d, "naming.functions")


_DOCS = """SELECT language, 'Doc comment coverage: ' || CASE WHEN r > 0.7 THEN 'high' WHEN r >= 0.3 THEN 'medium' ELSE 'low' END AS description,
round(CASE WHEN r > 0.7 THEN r WHEN r >= 0.3 THEN greatest(r, 0.5) ELSE greatest(1 - r, 0.5) END, 6) AS confidence, n AS evidence_count FROM dc"""


@query("WITH " + _CONV + " " + _DOCS)
def conv_docs(spark, d):
    return _conv(spark, d, "docs")


_TEST = """tt AS (SELECT count(*) FILTER (regexp_matches(path, '(_test\\.rs$)|(tests/)')) AS f, count(*) FILTER (regexp_matches(content, '#\\s*\\[cfg\\s*\\(\\s*test\\s*\\)\\]')) AS c FROM cc WHERE language = 'rust')"""


@query("WITH " + _CONV + ", " + _TEST + " SELECT 'rust' AS language, CASE WHEN f >= c THEN 'Tests in separate *_test.rs / tests/ files' ELSE 'Tests in #[cfg(test)] inline modules' END AS description, round(greatest(f, c) / (f + c), 6) AS confidence, greatest(f, c) AS evidence_count FROM tt WHERE f + c > 0")
def conv_testing(spark, d):
    r = V2.records(V2.language_counts(_conv_chunks(spark, d))).where("category = 'testing'")
    return r.select("language", "description", F.round("confidence", 6).alias("confidence"), "evidence_count")


@query("WITH " + _CONV + """ SELECT language, count(*) AS callables, count(*) FILTER (regexp_matches(content, '\\basync\\b')) AS asyncs FROM cc WHERE language = 'typescript' AND node_type IN ('function', 'method') GROUP BY language""")
def conv_async(spark, d):
    return V2.language_counts(_conv_chunks(spark, d)).where("language = 'typescript' and callables > 0").select("language", "callables", "asyncs")


@query("WITH " + _CONV + """ SELECT count(*) FILTER (regexp_matches(content, '\\banyhow\\b')) AS anyhow, count(*) FILTER (regexp_matches(content, '\\bthiserror\\b')) AS thiserror, count(*) FILTER (regexp_matches(content, '\\bAppError\\b')) AS app_error FROM cc WHERE language = 'rust'""")
def conv_error_handling(spark, d):
    return V2.language_counts(_conv_chunks(spark, d)).where("language = 'rust'").select(F.col("e0").alias("anyhow"), F.col("e1").alias("thiserror"), F.col("e2").alias("app_error"))


@query()
def conv_merge(spark, d):
    """One record per language and category, strong ones only."""
    return V2.merged(V2.records(V2.language_counts(_conv_chunks(spark, d)))).withColumn("confidence", F.round("confidence", 6))


@query("WITH " + _CONV + " SELECT language, confidence FROM (" + _DOCS + ") WHERE confidence >= 0.5 AND evidence_count >= 5 ORDER BY confidence DESC, language LIMIT 10")
def conv_list(spark, d):
    docs = V2.merged(V2.records(V2.language_counts(_conv_chunks(spark, d)))).where("category = 'docs'")
    return docs.select("language", F.round("confidence", 6).alias("confidence")).orderBy(F.desc("confidence"), "language").limit(10)


# --- metrics ---------------------------------------------------------------------------------------------------------

_RUNS = """h AS (SELECT DISTINCT run_id, task_id, lower(trim(condition)) AS condition, lower(trim(model)) AS model, seed, resolved FROM harness_runs),
pr AS (SELECT task_id, condition, avg(CAST(resolved AS INT)) >= 0.5 AS win, count(*) AS n FROM h WHERE condition IS NOT NULL GROUP BY task_id, condition)"""


def _runs(spark, d):
    return table(spark, d, "harness_runs").select("run_id", "task_id", F.lower(F.trim("condition")).alias("condition"), F.lower(F.trim("model")).alias("model"), "seed", "resolved").distinct()


@query(f"WITH {_RUNS} SELECT task_id, condition, win FROM pr")
def met_majority(spark, d):
    """Majority over the runs of a task, ties pass."""
    h = _runs(spark, d).where("condition is not null")
    return h.groupBy("task_id", "condition").agg((F.avg(F.col("resolved").cast("int")) >= 0.5).alias("win"))


@query(f"""WITH {_RUNS}, x AS (SELECT a.win AS a, b.win AS b FROM pr a JOIN pr b USING (task_id) WHERE a.condition = 'graph_only' AND b.condition = 'baseline'),
t AS (SELECT count(*) FILTER (a AND b) AS both_, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM x)
SELECT both_ AS "both", only_a, only_b, neither, round(least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda k: exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2))))), 6) AS p FROM t""")
def met_mcnemar(spark, d):
    wins = met_majority(spark, d)
    pick = lambda c: wins.where(F.col("condition") == c)
    return M.mcnemar(pick("graph_only"), pick("baseline"), ["task_id"], "win").withColumn("p", F.round("p", 6))


@query(f"WITH {_RUNS} SELECT condition, seed, round(avg(CAST(resolved AS INT)), 6) AS mean, count(*) AS n FROM h GROUP BY condition, seed")
def met_seed_means(spark, d):
    return _runs(spark, d).groupBy("condition", "seed").agg(F.round(F.avg(F.col("resolved").cast("int")), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RUNS}, c AS (SELECT model, count(*) AS n, count(*) FILTER (resolved) / count(*) AS p FROM h GROUP BY model)
SELECT model, n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS high FROM c""")
def met_wilson(spark, d):
    c = _runs(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("resolved"), 1)).alias("hits"))
    low, high = M.wilson(F.col("hits"), F.col("n"))
    return c.select("model", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query()
def met_bootstrap(spark, d):
    """Interval of the resolve rate by condition."""
    r = _runs(spark, d).select("run_id", "condition", F.col("resolved").cast("double").alias("v"))
    return M.bootstrap(r, ["condition"], "v", rounds=100)


_MET = f"""{_DOC_BM}, rk AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS place FROM bm QUALIFY place <= 100),
rl AS (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 800), jn AS (SELECT rk.*, rl.doc_id IS NOT NULL AS hit FROM rk LEFT JOIN rl USING (doc_id))"""


def _rank_metrics(spark, d):
    docs = table(spark, d, "documents")
    hits = R.ranked(R.fts_code(docs, CODE_QUERY, limit=100), [F.desc(F.round("score", 9)), F.col("doc_id")])
    rel = docs.where("lang = 'en' and n_chars > 800").select(F.lit("q").alias("query"), F.col("doc_id").alias("item"))
    return M.ranking_metrics(hits.select(F.lit("q").alias("query"), F.col("doc_id").alias("item"), "place"), rel, 20)


@query(f"WITH {_MET} SELECT round(count(*) FILTER (hit AND place <= 20) / (SELECT count(*) FROM rl), 6) AS recall FROM jn")
def met_recall_k(spark, d):
    return _rank_metrics(spark, d).select(F.round("recall", 6).alias("recall"))


@query(f"WITH {_MET} SELECT round(count(*) FILTER (hit AND place <= 20) / least(20, count(*)), 6) AS precision FROM jn")
def met_precision_k(spark, d):
    return _rank_metrics(spark, d).select(F.round("precision", 6).alias("precision"))


@query(f"WITH {_MET} SELECT round(coalesce(1.0 / min(place) FILTER (hit), 0), 6) AS mrr FROM jn")
def met_mrr(spark, d):
    return _rank_metrics(spark, d).agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


@query("""WITH f AS (SELECT DISTINCT project AS grp, doc_id FROM documents WHERE lang = 'en'), t AS (SELECT DISTINCT project AS grp, doc_id FROM documents WHERE n_chars > 800),
j AS (SELECT coalesce(f.grp, t.grp) AS grp, count(f.doc_id) AS nf, count(t.doc_id) AS nt, count(CASE WHEN f.doc_id IS NOT NULL AND t.doc_id IS NOT NULL THEN 1 END) AS b FROM f FULL JOIN t ON f.grp = t.grp AND f.doc_id = t.doc_id GROUP BY 1),
k AS (SELECT grp, CASE WHEN nf = 0 THEN 0.0 ELSE b / nf END AS p, CASE WHEN nt = 0 THEN 1.0 ELSE b / nt END AS r FROM j)
SELECT grp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM k""")
def met_set_prf(spark, d):
    x = table(spark, d, "documents").select(F.col("project").alias("grp"), "doc_id", "lang", "n_chars")
    m = M.set_prf(x.where("lang = 'en'"), x.where("n_chars > 800"), "grp", "doc_id")
    return m.select("grp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
