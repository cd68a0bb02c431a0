"""One object for everyday use: a store of tables and the commands that run over it.

    engine = Engine(spark, "/data/store")          # a folder of parquet tables: files, chunks, notes, ...
    engine.index("/src/project")                   # walk, chunk, extract edges, rank
    engine.search("stale cache").show()
    engine.memory.search("the final page", as_of="2026-03-15").show()

Every command returns a lazy DataFrame; only commands that write the store run jobs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset import schemas
from cairnset.functions import text as T
from cairnset.operators import chunking as C
from cairnset.operators import conventions as V
from cairnset.operators import live as L
from cairnset.operators import notes as N
from cairnset.operators import retrieval as R
from cairnset.operators.index import search_index, write_index
from cairnset.operators import symbols as G
from cairnset.operators import syntax as X2
from cairnset.session import cut, ship
from cairnset.sources import export as X
from cairnset.sources import files as S

def _search_texts(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("doc_id"), F.concat_ws(" ", "name", "content", "node_type").alias("text"))


TABLES = {"files": schemas.FILES, "chunks": schemas.CHUNKS, "edges": schemas.EDGES, "notes": schemas.NOTES, "note_edges": schemas.NOTE_EDGES, "vectors": "chunk_id string, embedding array<float>"}


class Engine:
    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store
        ship(spark)
        self.memory = Memory(self)

    def table(self, name: str) -> DataFrame:
        """A table of the store under its schema; an absent one is empty."""
        path = self._current(name) or os.path.join(self.store, f"{name}.parquet")  # a table brought along may stand in the open
        if not self._there(path):
            return self.spark.createDataFrame([], TABLES[name])
        return schemas.conform(self.spark.read.parquet(path), TABLES[name])

    def save(self, name: str, df: DataFrame) -> None:
        """Replace a table: the new version is written beside the one that is read, then a pointer is renamed over the old one.

        A write that fails leaves the table as it was; the version before stays for readers that have begun.
        """
        df.write.mode("overwrite").parquet(self._version_path(name, self._version(name) + 1))
        self._publish(name)

    def _version_path(self, name: str, version: int) -> str:
        return os.path.join(self.store, name, f"v{version}")

    def _version(self, name: str) -> int:
        pointer = os.path.join(self.store, name, "CURRENT")
        if not self._there(pointer):
            return 0
        path = self.spark._jvm.org.apache.hadoop.fs.Path(pointer)
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return int(text)

    def _current(self, name: str) -> str | None:
        version = self._version(name)
        return self._version_path(name, version) if version else None

    def _publish(self, name: str) -> None:
        """Make the version that was just written the current one and drop the one before the last."""
        jvm, conf, version = self.spark._jvm, self.spark._jsc.hadoopConfiguration(), self._version(name) + 1
        old, new = (jvm.org.apache.hadoop.fs.Path(os.path.join(self.store, name, x)) for x in ("CURRENT", "CURRENT.new"))
        fs = new.getFileSystem(conf)
        stream = fs.create(new, True)
        stream.write(bytearray(str(version), "ascii"))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(old), options)
        if version > 2:
            fs.delete(jvm.org.apache.hadoop.fs.Path(self._version_path(name, version - 2)), True)

    def index(self, root: str, now: int = 0, excludes: list[str] | None = None) -> DataFrame:
        """Walk a tree and bring files, chunks, edges and ranks up to date: only new and changed files are cut again."""
        seen = cut(S.read_tree(self.spark, root, excludes).withColumn("hash", F.sha2("text", 256)))
        old = self.table("files")
        change = cut(N.incremental_diff(old, seen, ["path"]))
        todo = seen.join(change.where(F.col("change").isin("new", "changed")).select("path"), "path", "left_semi")
        file_id = F.xxhash64("path")
        fresh = todo.select(file_id.alias("file_id"), "path", "language", "hash", F.lit(now).cast("long").alias("indexed_at"), F.lit(0).cast("long").alias("mtime"), "text")
        gone = change.where("change <> 'unchanged'").select(file_id.alias("file_id"), "path")
        doc = fresh.where("language = 'markdown'")
        code = X2.file_chunks(fresh.where("language <> 'markdown'")).select("file_id", "start_line", "end_line", F.col("name").alias("title"), F.lower("kind").alias("kind"), "content")
        cut_up = C.markdown_chunks(doc, "file_id", "text").select("file_id", "start_line", "end_line", F.col("name").alias("title"), "kind", "content").unionByName(code)
        chunks = cut_up.where(~T.has_secret(F.col("content"))).select(
            F.sha2(F.concat_ws(":", "file_id", "start_line", "end_line", "title"), 256).alias("chunk_id"), "file_id", F.col("kind").alias("node_type"), F.col("title").alias("name"), "start_line", "end_line", "content",
            F.lit(None).cast("string").alias("metadata"), T.tok_estimate(F.col("content")).alias("token_count"), F.lit(0.0).alias("graph_rank"), F.lit(None).cast("string").alias("summary"))
        chunks = cut(chunks)
        named = chunks.join(fresh.select("file_id", "path"), "file_id")
        edges = X2.file_edges(fresh.select("path", "language", "text")).unionByName(G.mention_edges(named))
        kept_edges = self.table("edges").join(gone.select(F.col("path").alias("source_file")), "source_file", "left_anti").select("source_file", "source_name", "target_name", "kind", "line").unionByName(edges)
        kept_chunks = self.table("chunks").join(gone.select("file_id"), "file_id", "left_anti").select(*chunks.columns).unionByName(chunks)
        kept_files = old.join(gone.select("path"), "path", "left_anti").select("file_id", "path", "language", "hash", "indexed_at", "mtime").unionByName(fresh.drop("text"))
        kept_edges = cut(kept_edges)
        rank = G.pagerank(kept_edges.where("kind = 'calls'").select(F.col("source_name").alias("src"), F.col("target_name").alias("dst"))).withColumnRenamed("node", "name")
        ranked = kept_chunks.join(rank, "name", "left").withColumn("graph_rank", F.coalesce("rank", "graph_rank")).select(*chunks.columns)
        ranked = cut(ranked)
        write_index(_search_texts(ranked), self._version_path("postings", self._version("postings") + 1))
        self._publish("postings")
        self.save("chunks", ranked)
        self.save("edges", kept_edges)
        self.save("files", kept_files)
        return change.groupBy("change").agg(F.count(F.lit(1)).alias("files"))

    def search(self, query: str, vector: list[float] | None = None, limit: int = 10, budget: int | None = None) -> DataFrame:
        """Words alone, or words and a query vector fused; with a token budget, what fits it in rank order."""
        if vector is None:
            hits = self.words(query, limit)
        else:
            near = self.table("vectors").select(F.col("chunk_id").alias("doc_id"), "embedding")
            hits = R.hybrid(None, near, query, vector, limit, words=lambda n: self.words(query, n))
        place = R.ranked(hits, [F.desc(F.round("score", 12)), F.col("doc_id")]).withColumnRenamed("doc_id", "chunk_id")
        full = place.join(self.table("chunks"), "chunk_id").join(self.table("files").select("file_id", "path"), "file_id").withColumn("tokens", F.col("token_count").cast("long"))
        kept = full if budget is None else R.budget_pack(full, budget, ["place"])
        return kept.select("place", "score", "chunk_id", "path", "name", "start_line", "end_line", "tokens", "content").orderBy("place")

    def find(self, query: str, vector: list[float] | None = None, root: str = ".", limit: int = 10, stale: bool = False) -> tuple[str, DataFrame]:
        """An automatic search and where its hits come from: the index where it can answer, the words of it, or the lines of the tree.

        `vector` is the embedded query, None if there is no embedder; `stale` says that files have changed since they were indexed.
        """
        chunks, embedded = self.table("chunks").count(), self.table("vectors").where("embedding is not null").count()
        if L.rung(chunks, embedded, vector is not None) == "index":
            hits = cut(self.search(query, vector, limit))
            step = L.next_rung(hits.count(), chunks, embedded, stale)
            if step == "done":
                return "index", hits
            if step == "text":
                return "text", self.search(query, None, limit)
        return "live", L.matching_lines(S.read_tree(self.spark, root), L.literal(query), limit=limit)

    def words(self, query: str, limit: int) -> DataFrame:
        """doc_id, score of the best chunks by their words, from the stored postings; a store without any is read in full."""
        if stored := self._current("postings"):
            return search_index(self.spark, stored, query, limit=limit)
        return R.fts_code(_search_texts(self.table("chunks")), query, limit=limit)

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def knn(self, vector: list[float], limit: int = 10, least: float = 0.0) -> DataFrame:
        near = R.knn_int8(self.table("vectors"), vector, limit + 20, key="chunk_id").withColumn("score", 1 - F.col("distance"))
        return near.where(F.col("score") >= least).orderBy(F.round("raw", 9), "chunk_id").limit(limit)

    def graph(self, symbol: str, kind: str | None = None) -> DataFrame:
        """Edges of a symbol (or of a file, if the name looks like a path)."""
        e = self.table("edges")
        of_symbol, of_file = e.where((F.col("source_name") == symbol) | (F.col("target_name") == symbol)), e.where(F.col("source_file") == symbol)
        both = G.union_edges(of_file, of_symbol)
        return (both if kind is None else both.where(F.col("kind") == kind)).orderBy("kind", "target_name")

    def related(self, query: str, vector: list[float], limit: int = 10) -> DataFrame:
        """Graph-diffused retrieval: the hybrid pool spread over the symbols its chunks mention."""
        docs = self.table("chunks").select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text"))
        pool = R.hybrid(None, self.table("vectors").select(F.col("chunk_id").alias("doc_id"), "embedding"), query, vector, min(300, max(50, 5 * limit)), words=lambda n: self.words(query, n))
        near = cut(R.min_max_similarity(pool.withColumn("distance", 1 / F.col("score"))).select(F.col("doc_id").alias("chunk"), "similarity"))
        mentions = lambda rows: rows.select(F.col("doc_id").alias("chunk"), F.explode(G.mention_tokens(F.col("text"))).alias("symbol"))
        own = docs.join(F.broadcast(near.select(F.col("chunk").alias("doc_id"))), "doc_id")  # at most 300 rows
        return G.linear_rag(near, mentions(docs), limit, pool_mentions=mentions(own))

    def status(self) -> DataFrame:
        f = self.table("files").agg(F.count(F.lit(1)).alias("files"), F.max("indexed_at").alias("last_indexed"))
        c = self.table("chunks").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
        return f.crossJoin(c).crossJoin(self.table("notes").agg(F.count(F.lit(1)).alias("notes")))  # single rows

    def ls_files(self) -> DataFrame:
        n = self.table("chunks").groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
        return self.table("files").join(n, "file_id", "left").select("path", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("chunks", F.lit(0)).alias("chunks")).orderBy("path")

    def cat_chunks(self, path: str) -> DataFrame:
        f = self.table("files").where(F.lower("path").endswith(path.lower())).select("file_id", "path")
        return self.table("chunks").join(f, "file_id").orderBy("path", "start_line")

    def languages(self) -> DataFrame:
        return self.table("files").groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language")

    def conventions(self) -> DataFrame:
        c = self.table("chunks").join(self.table("files").select("file_id", "path", "language"), "file_id").select("language", "node_type", "name", "content", "path")
        return V.merged(V.records(V.language_counts(c)))

    def export(self, path: str) -> DataFrame:
        """Write notes and their relationships as verified JSON lines."""
        notes, edges = self.table("notes"), X.relationships(self.table("note_edges"), self.table("notes"))
        link = F.concat(F.col("from_id").cast("string"), F.lit(">"), F.col("to_id").cast("string"), F.lit(":"), F.col("kind"))
        records = notes.select(F.lit("note").alias("kind"), F.col("id").cast("string").alias("ref"), F.to_json(F.struct("*")).alias("payload")).unionByName(
            edges.select(F.lit("relationship").alias("kind"), link.alias("ref"), F.to_json(F.struct("*")).alias("payload")))
        return X.write_dump(records, path)


class Memory:
    """Commands over the notes of a store."""

    def __init__(self, engine: Engine):
        self.e = engine

    def _at(self, as_of: str | None) -> int | None:
        if as_of is None:
            return None
        at = self.e.spark.range(1).select(T.parse_as_of(F.lit(as_of))).first()[0]
        if at is None:
            raise ValueError(f"not a date or time: {as_of}")
        return at

    def add(self, notes: DataFrame) -> None:
        """Add notes; one whose content is stored already unites its tags and files with the stored one."""
        new = schemas.conform(notes, schemas.NOTES).withColumn("entity_id", T.entity_id(F.col("kind"), F.col("title"), F.col("body")))
        kept, _ = N.dedupe_entities(self.e.table("notes").unionByName(new))
        self.e.save("notes", kept)

    def list(self, kind: str | None = None, as_of: str | None = None, archived: bool = False, limit: int = 500) -> DataFrame:
        n = R.as_of(self.e.table("notes"), self._at(as_of), archived)
        return (n if kind is None else n.where(F.col("kind") == kind)).orderBy(F.desc("created_at"), "id").limit(min(500, limit))

    def search(self, query: str, as_of: str | None = None, limit: int = 20) -> DataFrame:
        hits = R.fts_memory(self.e.table("notes"), query, limit=None)
        return R.as_of(hits, self._at(as_of)).orderBy(F.desc(F.round("score", 9)), "id").limit(min(1000, limit))

    def timeline(self, query: str, limit: int = 50) -> DataFrame:
        return R.timeline(self.e.table("notes"), query, min(200, limit))

    def archive(self, ids: list[int]) -> None:
        n = self.e.table("notes")
        self.e.save("notes", n.withColumn("status", F.when((F.col("status") == "active") & F.col("id").isin(ids), "archived").otherwise(F.col("status"))))

    def supersede(self, mapping: DataFrame, now: int) -> None:
        notes, edges = N.supersede(self.e.table("notes"), mapping, now)
        links = N.insert_or_ignore(self.e.table("note_edges"), edges, ["from_id", "to_id", "kind"])
        self.e.save("note_edges", links)
        self.e.save("notes", notes)

    def dedupe(self) -> DataFrame:
        kept, redirect = N.dedupe_entities(self.e.table("notes"))
        merged = cut(redirect)
        self.e.save("notes", kept)
        return merged.agg(F.countDistinct("survivor").alias("groups"), F.count(F.lit(1)).alias("removed"))

    def graph(self, note_id: int) -> DataFrame:
        e, titles = self.e.table("note_edges"), self.e.table("notes").select(F.col("id").alias("other"), "title")
        out = e.where(F.col("from_id") == note_id).select(F.lit("out").alias("direction"), F.col("to_id").alias("other"), "kind", "created_at")
        back = e.where(F.col("to_id") == note_id).select(F.lit("in").alias("direction"), F.col("from_id").alias("other"), "kind", "created_at")
        return N.link_by(out.unionByName(back), titles, "other", F.lit("(deleted)"), "title").orderBy("created_at")

    def since(self, cursor: str | None, limit: int = 100) -> DataFrame:
        return N.keyset_page(self.e.table("notes").where("remote_id is not null"), "remote_id", cursor, limit)

    def import_log(self, path: str) -> DataFrame:
        """Fold a JSON-lines log and import the entities that are not stored yet."""
        log = X.read_log(self.e.spark.read.text(path))
        keyed = log.withColumn("entity_id", F.coalesce("entity_id", T.entity_id(F.col("kind"), F.col("title"), F.col("body"))))
        folded = N.fold_records(keyed)
        fresh = cut(schemas.conform(folded.join(self.e.table("notes").select("entity_id"), "entity_id", "left_anti"), schemas.NOTES))
        self.e.save("notes", self.e.table("notes").unionByName(fresh))
        return fresh.agg(F.count(F.lit(1)).alias("imported"))
