"""Symbol graph: calls, mentions, neighbours, PageRank and its personalised form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cairnset.functions import text as T
from cairnset.operators.syntax import NOT_CALLED, builtins_of
from cairnset.session import cut, salted_join

EDGE_KINDS = ["imports", "calls", "extends", "implements", "mentions"]
#: Languages whose line comments open with a hash sign, or with that or two slashes, or with two dashes; in all others they open with two slashes.
HASH, EITHER, DASHES = ["python", "ruby"], ["php", "hcl"], ["sql"]
STOP = ["the", "and", "for", "let", "var", "const", "pub", "use", "mut", "def", "not", "self", "this", "return", "if", "else", "while", "function", "class", "struct",
        "impl", "enum", "type", "true", "false", "null", "None", "True", "False", "import", "from", "async", "await", "static", "void", "int", "char", "string"]


def edge_kind(c: Column) -> Column:
    """Unknown kinds read as imports."""
    return F.when(F.lower(c).isin(EDGE_KINDS), F.lower(c)).otherwise(F.lit("imports"))


def strip_comments(c: Column, language: Column | None = None) -> Column:
    """Without block and line comments of the language (null or none given: of any) and the insides of string literals."""
    c = F.regexp_replace(c, r"(?s)/\*.*?\*/", " ")
    c = F.regexp_replace(c, r"\"[^\"\n]*\"|'[^'\n]*'", "\"\"")
    without = lambda mark: F.regexp_replace(c, mark + r"[^\n]*", " ")
    if language is None:
        return without("(//|#)")
    return F.when(language.isNull() | language.isin(EITHER), without("(//|#)")).when(language.isin(HASH), without("#")).when(language.isin(DASHES), without("--")).otherwise(without("//"))


def mention_tokens(content: Column, most: int = 40, language: Column | None = None) -> Column:
    """Distinct identifiers in order of first appearance: 3 to 50 characters, not all digits, no stop words, at most 40."""
    found = F.array_distinct(F.regexp_extract_all(strip_comments(content, language), F.lit(r"(\w+)"), 1))
    stop = F.array(*[F.lit(s) for s in STOP])
    keep = F.filter(found, lambda x: F.char_length(x).between(3, 50) & ~x.rlike("^[0-9]+$") & ~F.array_contains(stop, x))
    return F.slice(keep, 1, most)


def mention_edges(chunks: DataFrame) -> DataFrame:
    """chunks(path, name, content): a mentions edge from each named chunk to each of its tokens."""
    named = chunks.where("name is not null").select("path", "name", "content", T.lang_detect(F.col("path")).alias("__lang"))
    language = F.col("__lang")
    return named.select(F.col("path").alias("source_file"), F.col("name").alias("source_name"), F.explode(mention_tokens(F.col("content"), language=language)).alias("target_name"),
                        F.lit("mentions").alias("kind"), F.lit(0).alias("line"))


def call_edges(chunks: DataFrame) -> DataFrame:
    """Calls of a chunk by name, built-ins left out, once per (source, target)."""
    named = chunks.where("name is not null").select("path", "name", "content", T.lang_detect(F.col("path")).alias("__lang"))
    bare = strip_comments(F.col("content"), F.col("__lang"))
    called = named.select(
        F.col("path").alias("source_file"), F.col("name").alias("source_name"), "__lang", F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_]\w*)\("), 1))).alias("target_name"))
    return called.where(~F.coalesce(is_builtin(F.col("target_name"), F.col("__lang")), F.lit(False)) & (F.col("target_name") != F.col("source_name"))).drop("__lang").withColumn("kind", F.lit("calls")).distinct()


def is_builtin(name: Column, language: Column) -> Column:
    """Whether a name comes with the language or is no name of a function in any of them."""
    own = F.lit(False)
    for g in ("rust", "python", "javascript", "jsx", "typescript", "tsx", "go", "php", "ruby", "csharp", "kotlin", "swift", "c", "cpp"):
        own = F.when(language == g, name.isin(builtins_of(g))).otherwise(own)
    return own | name.isin(NOT_CALLED)


def html_edges(pages: DataFrame, text: str = "text") -> DataFrame:
    """Targets of src and href attributes; empty, in-page and data targets left out."""
    found = pages.select("*", F.explode(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:src|href)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), 1)).alias("target_name"))
    found = found.withColumn("target_name", F.regexp_replace("target_name", r"^[\"']|[\"']$", ""))
    t = F.trim("target_name")
    return found.withColumn("target_name", t).where((t != "") & ~t.startswith("#") & ~t.startswith("data:")).withColumn("kind", F.lit("imports"))


def neighbours(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Names one call away from `names(name)`, either way, each once."""
    calls = edges.where("kind = 'calls'")
    out = calls.join(names.withColumnRenamed("name", "source_name"), "source_name", "left_semi").select(F.col("target_name").alias("name"))
    back = calls.join(names.withColumnRenamed("name", "target_name"), "target_name", "left_semi").select(F.col("source_name").alias("name"))
    return out.union(back).where("name is not null").distinct()


#: Links that one task walks by itself; a larger graph is walked by joins, with the same result.
TASK_LINKS = 1_000_000


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, personal: DataFrame | None = None) -> DataFrame:
    """edges(src, dst) to (node, rank). Self loops are dropped, repeated edges count, what ends nowhere is spread evenly.

    With `personal(node, weight)` jumps and dangling mass go to it instead (weights over their sum; nodes outside get 0).
    In a large graph a round is one salted join and one aggregate; every second one is written to the shared folder, so the plan
    stays small and a lost executor costs two rounds at most.
    """
    real = edges.where("src <> dst")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    out = real.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    grouped = real.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    base = nodes.join(out.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left").select("node", F.coalesce("dangling", F.lit(True)).alias("dangling"))
    if personal is not None:
        total = personal.agg(F.sum("weight")).first()[0] or 0.0
        base = base.join(personal.groupBy("node").agg((F.sum("weight") / F.lit(total or 1.0)).alias("jump")), "node", "left").fillna({"jump": 0.0})
    base = cut(base)
    n = base.count()
    if not n:
        return base.select("node", F.lit(0.0).alias("rank"))
    if personal is None:
        base = base.withColumn("jump", F.lit(1.0 / n))
    grouped = cut(grouped)
    if n + grouped.count() <= TASK_LINKS:
        return _walk_in_one_task(base, grouped, rounds, damping)
    links = cut(salted_join(grouped, out, "src").select("src", "dst", (F.col("times") / F.col("out")).alias("share")))
    rest = base.select("node", "dangling", "jump", F.lit(0.0).alias("got"))
    state = base.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds):
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        inflow = salted_join(links, state.select(F.col("node").alias("src"), "rank"), "src").select(
            F.col("dst").alias("node"), F.lit(None).cast("boolean").alias("dangling"), F.lit(None).cast("double").alias("jump"), (F.col("share") * F.col("rank")).alias("got"))
        mixed = inflow.unionByName(rest).groupBy("node").agg(F.max("dangling").alias("dangling"), F.max("jump").alias("jump"), F.sum("got").alias("got"))
        state = mixed.crossJoin(F.broadcast(lost)).select(  # one row
            "node", "dangling", "jump", (((1 - damping) + damping * F.col("lost")) * F.col("jump") + damping * F.col("got")).alias("rank"))
        if i % 2 or i + 1 == rounds:  # a round reads the one before twice, so more than two would double the plan again
            state = cut(state)
    return state.select("node", "rank")


def _steps(src: np.ndarray, dst: np.ndarray, times: np.ndarray, jump: np.ndarray, rounds: int, damping: float) -> np.ndarray:
    """Ranks of nodes 0 .. n - 1 after so many rounds; a node without links out gives its rank to the jump."""
    n = len(jump)
    out = np.bincount(src, times, n)
    share, dangling, rank = times / out[src], out == 0, np.full(n, 1.0 / n)
    for _ in range(rounds):
        rank = ((1 - damping) + damping * rank[dangling].sum()) * jump + damping * np.bincount(dst, share * rank[src], n)
    return rank


def _walk_in_one_task(base: DataFrame, grouped: DataFrame, rounds: int, damping: float) -> DataFrame:
    kind = base.schema["node"].dataType
    none = F.lit(None)
    rows = base.select("node", none.cast(kind).alias("src"), none.cast(kind).alias("dst"), none.cast("long").alias("times"), "jump").union(
        grouped.select(none.cast(kind), "src", "dst", F.col("times").cast("long"), none.cast("double")))

    def walk(t: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        own, link = t.filter(pc.is_valid(t.column("node"))), t.filter(pc.is_valid(t.column("times")))
        names = own.column("node").combine_chunks()
        at = lambda c: pc.index_in(link.column(c), names).to_numpy().astype(np.int64)
        rank = _steps(at("src"), at("dst"), link.column("times").to_numpy().astype(float), own.column("jump").to_numpy(), rounds, damping)
        return pa.table({"node": names, "rank": pa.array(rank)})

    return rows.groupBy(F.lit(0).alias("all")).applyInArrow(walk, StructType([StructField("node", kind), StructField("rank", DoubleType())]))


def union_edges(of_file: DataFrame, of_symbol: DataFrame) -> DataFrame:
    """The file's edges, then the symbol's unless (source_file, target, kind, line) is there already; source_name does not count."""
    key = ["source_file", "target_name", "kind", "line"]
    both = of_file.withColumn("prio", F.lit(0)).unionByName(of_symbol.withColumn("prio", F.lit(1)))
    extra = both.withColumn("first", F.min("prio").over(W.partitionBy(*key)))
    return extra.where("prio = first").drop("prio", "first")


def linear_rag(pool: DataFrame, mentions: DataFrame, limit: int, floor: float = 0.25, top_symbols: int = 150, per_symbol: int = 50, most_new: int = 500,
               pool_mentions: DataFrame | None = None) -> DataFrame:
    """Graph-diffused ranking of a pool(chunk, similarity) over mentions(chunk, symbol), a bag.

    Symbols take the best similarity of the pool chunks that mention them and count if over `floor`; the best symbols bring in
    further chunks; a personalised PageRank over chunk-symbol edges in both directions is averaged with the similarity. Edges
    from pool chunks to kept symbols enter twice, as found and again when the symbols are expanded. No symbol over the floor:
    the pool by similarity. `pool_mentions`: the mentions of the pool's chunks, where they can be had without all others.

    The graph has at most (pool + most_new) * top_symbols edges, repeated ones counted, so the walk is one task.
    """
    small = F.broadcast(pool.select("chunk"))  # a limited result list
    known = cut((mentions.join(small, "chunk") if pool_mentions is None else pool_mentions).select("chunk", "symbol"))
    seen = known.join(pool, "chunk").groupBy("symbol").agg(F.max("similarity").alias("heat")).where(F.col("heat") > floor)
    best = cut(seen.orderBy(F.desc(F.round("heat", 9)), "symbol").limit(top_symbols))
    own = known.join(F.broadcast(best.select("symbol")), "symbol", "left_semi").select("chunk", "symbol")
    wide = cut(mentions.join(F.broadcast(best), "symbol").join(small, "chunk", "left_anti").select("chunk", "symbol", "heat").distinct())
    place = F.row_number().over(W.partitionBy("symbol").orderBy("chunk"))
    fresh = wide.withColumn("p", place).where(F.col("p") <= per_symbol).groupBy("chunk").agg(F.max("heat").alias("h")).orderBy(F.desc(F.round("h", 9)), "chunk").limit(most_new)
    fresh = cut(fresh.select("chunk"))
    added = wide.join(F.broadcast(fresh), "chunk", "left_semi").select("chunk", "symbol")
    bag = own.unionAll(own).unionAll(added).groupBy("chunk", "symbol").agg(F.count(F.lit(1)).alias("times"))
    known_chunks = pool.select("chunk", "similarity").unionByName(fresh.withColumn("similarity", F.lit(0.0)))
    kind, none = pool.schema["chunk"].dataType, F.lit(None)
    rows = known_chunks.select("chunk", none.cast("string").alias("symbol"), none.cast("long").alias("times"), F.col("similarity").cast("double").alias("weight")).union(
        best.select(none.cast(kind), "symbol", none.cast("long"), F.col("heat").cast("double"))).union(bag.select("chunk", "symbol", "times", none.cast("double")))

    def walk(t: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        link = t.filter(pc.is_valid(t.column("times")))
        of = lambda a, b: t.filter(pc.and_(pc.is_valid(t.column(a)), pc.is_null(t.column(b))))
        chunks, symbols = of("chunk", "symbol"), of("symbol", "chunk")
        names, words = chunks.column("chunk").combine_chunks(), symbols.column("symbol").combine_chunks()
        c = pc.index_in(link.column("chunk"), names).to_numpy().astype(np.int64)
        s = pc.index_in(link.column("symbol"), words).to_numpy().astype(np.int64) + len(names)
        similarity = chunks.column("weight").to_numpy()
        if not len(words):
            return pa.table({"chunk": names, "score": pa.array(similarity)})
        weight = np.r_[similarity, symbols.column("weight").to_numpy()]
        at, inverse = np.unique(np.r_[c, s], return_inverse=True)  # only what has an edge is a node
        n, times = len(c), link.column("times").to_numpy().astype(float)
        rank = np.zeros(len(weight))
        rank[at] = _steps(inverse, np.r_[inverse[n:], inverse[:n]], np.r_[times, times], weight[at] / (weight.sum() or 1.0), 20, 0.85)
        rank = rank[: len(names)]
        return pa.table({"chunk": names, "score": pa.array(0.5 * similarity + 0.5 * rank / max(rank.max(initial=0.0), 1e-12))})

    mixed = rows.groupBy(F.lit(0).alias("all")).applyInArrow(walk, StructType([StructField("chunk", kind), StructField("score", DoubleType())]))
    return mixed.orderBy(F.desc(F.round("score", 9)), "chunk").limit(limit)

