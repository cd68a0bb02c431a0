"""Ranked retrieval: BM25 by words and by phrase, quantised and float nearest neighbours, fusion, timelines, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnset.functions import text as T
from cairnset.session import cut, spread

K1, B, RRF_K = 1.2, 0.75, 60


def _bm25(docs: DataFrame, counts: dict[str, Column], length: Column, may: str | None = None) -> DataFrame:
    """Scores of documents that hold at least one of the counted terms.

    One pass gathers the document frequencies, a second scores: neither shuffles more than one row of totals per task.
    """
    test = (lambda c: c) if may is None else (lambda c: F.when(F.col(may), c).otherwise(0))
    counted = docs.withColumns({**{f"__tf{i}": test(c) for i, c in enumerate(counts.values())}, "__dl": length})
    totals = counted.agg(
        F.count(F.lit(1)).alias("__n"), F.avg("__dl").alias("__avg"), *[F.count(F.when(F.col(f"__tf{i}") > 0, 1)).alias(f"__df{i}") for i in range(len(counts))])
    scored = (counted if may is None else counted.where(may)).where(" or ".join(f"__tf{i} > 0" for i in range(len(counts)))).crossJoin(F.broadcast(totals))  # one row of totals
    score = F.lit(0.0)
    for i in range(len(counts)):
        df, tf = F.col(f"__df{i}"), F.col(f"__tf{i}").cast("double")
        idf = F.log((F.col("__n") - df + 0.5) / (df + 0.5))
        norm = tf + K1 * (1 - B + B * F.col("__dl") / F.col("__avg"))
        score = score + F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * tf * (K1 + 1) / norm
    return scored.select(*docs.columns, score.alias("score"))


def fts_code(docs: DataFrame, query: str, text: str = "text", key: str = "doc_id", limit: int = 1000) -> DataFrame:
    """Any of the query's words; a blank query finds nothing. Punctuation never fails. Best first, ties by key."""
    import re

    terms = list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.replace("\0", "").lower()) if w))
    if not terms:
        return docs.select(key).withColumn("score", F.lit(0.0)).limit(0)
    # a document without any of the terms as a substring holds none of them as a word: its words are counted, not compared
    some = F.lower(text).contains(terms[0])
    for t in terms[1:]:
        some = some | F.lower(text).contains(t)
    words = T.words(F.col(text))
    times = lambda t: F.size(F.filter("__w", lambda x: x == t))
    counts = {t: times(F.lit(t)) for t in terms}
    may = F.coalesce(some, F.lit(False))
    read = spread(docs.select(key, text), key).select(key, words.alias("__w"), may.alias("__may"))
    # texts are read once: what both the totals and the scores need of them is a few numbers a document
    slim = cut(read.select(key, F.size("__w").alias("__dl"), *[F.when(F.col("__may"), c).otherwise(0).alias(f"__n{i}") for i, c in enumerate(counts.values())]))
    ranked = _bm25(slim, {t: F.col(f"__n{i}") for i, t in enumerate(counts)}, F.col("__dl"))
    return ranked.select(key, "score").orderBy(F.desc(F.round("score", 9)), key).limit(limit)


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in the words, overlaps included."""
    n = len(phrase)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1))
    return F.size(F.filter(at, lambda i: F.slice(words, i, n) == F.array(*[F.lit(p) for p in phrase])))


def fts_memory(notes: DataFrame, query: str, key: str = "id", limit: int | None = 1000) -> DataFrame:
    """The whole query as one phrase over title, body and tags; limit None: every hit, in no order. `notes` carries title, body, tags."""
    import re

    phrase = [w for w in re.split(r"[\W_]+", query.replace("\0", "").lower()) if w]
    if not phrase:
        return notes.withColumn("score", F.lit(0.0)).limit(0)
    text = F.concat_ws(" \n ", "title", "body", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    all_in = F.lit(True)
    for p in phrase:
        all_in = all_in & F.lower(text).contains(p)
    ranked = _bm25(notes.withColumns({"__w": T.words(text), "__may": F.coalesce(all_in, F.lit(False))}), {"phrase": phrase_count(F.col("__w"), phrase)}, F.size("__w"), "__may")
    hits = ranked.drop("__w", "__may")
    return hits if limit is None else hits.orderBy(F.desc(F.round("score", 9)), key).limit(limit)


def as_of(notes: DataFrame, at: int | None, archived: bool = False) -> DataFrame:
    """Active notes, or those valid at an instant whatever their status: [coalesce(valid_at, created_at), invalid_at)."""
    if at is None:
        return notes if archived else notes.where(F.col("status") == "active")
    return notes.where((F.coalesce("valid_at", "created_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)))


def timeline(notes: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """The best phrase hits of any status, then in the order of their time."""
    return fts_memory(notes, query, limit=limit).withColumn("at", F.coalesce("valid_at", "created_at")).orderBy("at", "id")


def quantise_int8(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * 127).cast("int"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def _literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in v])


def knn_int8(vectors: DataFrame, query: list[float], limit: int, key: str = "vec_id", rank: str | None = None) -> DataFrame:
    """Both sides as 8-bit integers, nearest by raw distance; `distance` blends in a rank but does not order."""
    q = quantise_int8(_literal(query))
    raw = vectors.withColumn("raw", l2(quantise_int8(F.col("embedding")), q) / 127)
    top = raw.orderBy(F.round("raw", 9), key).limit(min(limit, 1000))
    return top.withColumn("distance", 0.85 * F.col("raw") - 0.15 * (F.col(rank) if rank else F.lit(0.0)))


def knn_float(vectors: DataFrame, query: list[float], limit: int, key: str = "vec_id") -> DataFrame:
    d = vectors.withColumn("distance", l2(F.col("embedding"), _literal(query)))
    return d.orderBy(F.round("distance", 9), key).limit(min(limit, 100))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """1-based place of each row of an already limited list."""
    return df.withColumn("place", F.row_number().over(W.orderBy(*order)))


def rrf(lists: list[DataFrame], key: str, limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of limited lists (key, place): best first, ties by key."""
    parts = None
    for x in lists:
        one = x.select(key, (1.0 / (k + F.col("place"))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    fused = parts.groupBy(key).agg(F.sum("part").alias("score"))
    return fused.orderBy(F.desc(F.round("score", 12)), key).limit(limit)


def hybrid(docs: DataFrame | None, vectors: DataFrame, query: str, vector: list[float], limit: int = 10, words: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """Word and vector hits fused; max(3 * limit, 20) candidates of each. `vectors` has doc_id, embedding.

    `words` gives the best word hits of a number, from a stored index; without it the documents are read.
    """
    n = max(3 * limit, 20)
    text = ranked(words(n) if words else fts_code(docs, query, limit=n), [F.desc(F.round("score", 9)), F.col("doc_id")])
    near = ranked(knn_int8(vectors, vector, n, key="doc_id"), [F.round("raw", 9), F.col("doc_id")])
    return rrf([text, near], "doc_id", limit)


def min_max_similarity(df: DataFrame, distance: str = "distance") -> DataFrame:
    """1 - (d - min) / max(range, 1e-6) over a whole limited list (a few hundred rows: one window, one pass)."""
    whole = W.partitionBy()
    low, high = F.min(distance).over(whole), F.max(distance).over(whole)
    return df.withColumn("similarity", 1 - (F.col(distance) - low) / F.greatest(high - low, F.lit(1e-6)))


def budget_pack(hits: DataFrame, budget: int, order: list[str], stop_below: int = 10) -> DataFrame:
    """Greedy in rank order: take what fits, skip what does not, stop once less than `stop_below` is left.

    `hits` is a limited result list (at most 1,000 rows by the caps above), so the fold runs over one small array.
    """
    items = hits.select(F.struct(*order, "tokens").alias("i"), F.struct("*").alias("r")).agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("all"))
    fold = F.aggregate(
        "all", F.struct(F.lit(budget).cast("long").alias("left"), F.lit(False).alias("done"), F.array().cast("array<int>").alias("takes")),
        lambda acc, x: F.struct(
            F.when(~acc.done & (acc.left >= stop_below) & (x.i.tokens <= acc.left), acc.left - x.i.tokens).otherwise(acc.left).cast("long").alias("left"),
            (acc.done | (acc.left < stop_below)).alias("done"),
            F.concat(acc.takes, F.array(F.when(~acc.done & (acc.left >= stop_below) & (x.i.tokens <= acc.left), 1).otherwise(0))).alias("takes")))
    flagged = items.select(F.explode(F.arrays_zip(F.col("all"), fold.takes.alias("takes"))).alias("z"))
    return flagged.where("z.takes = 1").select("z.all.r.*")


#: Kinds in the order in which they compete for a budget; other kinds come after them, conventions last.
PACK_PRIORITY = ["decision", "requirement", "handoff", "question"]


def context_pack(notes: DataFrame, conventions: DataFrame, budget: int, caps: dict[str, int], default: int) -> DataFrame:
    """What of the capped sections and of conventions(category, description) fits a token budget: source, ref, kind, tokens.

    Greedy: sections by the priority of their kind, latest notes first, what does not fit is skipped and the next one tried.
    """
    place = {k: i for i, k in enumerate(PACK_PRIORITY)}
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in place.items() for x in p]), F.col("kind")), F.lit(len(place)))
    kept = section_cap(notes, caps, default).select(
        F.lit("note").alias("source"), F.col("id").cast("string").alias("ref"), "kind", rank.alias("prio"), F.when(rank == len(place), F.col("kind")).otherwise("").alias("other"), "place",
        (T.tok_estimate(F.coalesce("title", F.lit(""))) + T.tok_estimate(F.coalesce("body", F.lit("")))).cast("long").alias("tokens"))
    rules = conventions.select(
        F.lit("convention").alias("source"), F.col("description").alias("ref"), F.col("category").alias("kind"), F.lit(len(place) + 1).alias("prio"), F.lit("").alias("other"), F.lit(0).alias("place"),
        (T.tok_estimate(F.col("category")) + T.tok_estimate(F.col("description"))).cast("long").alias("tokens"))
    return budget_pack(kept.unionByName(rules), budget, ["prio", "other", "place", "kind", "ref"], stop_below=0).select("source", "ref", "kind", "tokens")


def coverage(embedded: Column, total: Column, auto: Column) -> Column:
    """How far an index is embedded: complete (or nothing to embed), partial, and without any: to the live search in auto mode, else an error."""
    return F.when(embedded >= total, "complete").when(embedded > 0, "partial").when(auto, "zero_falls_back").otherwise("zero_is_an_error")


def section_cap(notes: DataFrame, caps: dict[str, int], default: int) -> DataFrame:
    """The latest notes of each kind, up to the kind's cap."""
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in caps.items() for x in p]), F.col("kind")), F.lit(default))
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("created_at"), "id"))
    most = max([default, *caps.values()])
    return notes.withColumn("place", place).where(F.col("place") <= most).where(F.col("place") <= cap)


def merge_sources(parts: list[DataFrame], key: list[str], distance: str, limit: int, tie: list[str]) -> DataFrame:
    """Hits of several projects: the nearest of each key, nearest first, cut to the limit."""
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    best = W.partitionBy(*key).orderBy(F.round(distance, 9), *tie)
    return all_parts.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn").orderBy(F.round(distance, 9), *tie).limit(limit)


Q_BLOCK, R_BLOCK = 2_048, 65_536


def near_in_blocks(queries: DataFrame, rows: DataFrame, radius: float, limit: int, key: str = "vec_id", earlier: bool = False) -> DataFrame:
    """A stated query set against all rows: id_a, id_b, distance, place of the nearest rows within a radius, exactly.

    Queries and rows are dealt into blocks of bounded size and every pair of blocks is one task: a matrix product finds what
    may be within the radius, exact distances decide. The cost is queries times rows, never rows times rows; each pair of
    blocks gives at most `limit` rows per query. `earlier`: only rows with a smaller key than the query's. A row is never its
    own neighbour; null vectors and keys have none; all vectors must be of one length. Ties by key.
    """
    import numpy as np
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[key].dataType
    type_a = to_arrow_type(kind)
    parts_q, parts_r = max(1, -(-queries.count() // Q_BLOCK)), max(1, -(-rows.count() // R_BLOCK))
    usable = lambda df: df.where(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.col("embedding").cast("array<double>").alias("embedding"))
    share = lambda parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = usable(queries).select(F.col(key).alias("id_a"), F.col("embedding").alias("ea"), share(parts_q).alias("qa"), every(parts_r).alias("ra"))
    right = usable(rows).select(F.col(key).alias("id_b"), F.col("embedding").alias("eb"), share(parts_r).alias("rb"), every(parts_q).alias("qb"))
    schema = f"id_a {kind.simpleString()}, id_b {kind.simpleString()}, distance double"

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def search(q: pa.Table, r: pa.Table) -> pa.Table:
        out_a, out_b, out_d = [], [], []
        if q.num_rows and r.num_rows:
            r = r.sort_by("id_b")
            a, b = matrix(q.column("ea")), matrix(r.column("eb"))
            ids_a, ids_b = np.array(q.column("id_a").to_pylist(), object), np.array(r.column("id_b").to_pylist(), object)
            norm_b = (b * b).sum(1)
            for i in range(len(a)):
                square = norm_b - 2 * (b @ a[i]) + a[i] @ a[i]
                near = np.flatnonzero(square <= (radius + 1e-6) ** 2)
                near = near[(ids_b[near] < ids_a[i]) if earlier else (ids_b[near] != ids_a[i])]
                if len(near) > 4 * limit:  # what is farther than the last of the limit cannot be among them
                    near = near[square[near] <= np.partition(square[near], limit - 1)[limit - 1] + 1e-6]
                d = np.sqrt(((b[near] - a[i]) ** 2).sum(1))
                best = [j for j in np.argsort(np.round(d, 9), kind="stable")[:limit] if d[j] <= radius + 1e-9]
                out_a += [ids_a[i]] * len(best)
                out_b += ids_b[near[best]].tolist() if best else []
                out_d += d[best].tolist() if best else []
        return pa.table({"id_a": pa.array(out_a, type_a), "id_b": pa.array(out_b, type_a), "distance": pa.array(out_d, pa.float64())})

    found = left.groupBy("qa", "ra").cogroup(right.groupBy("qb", "rb")).applyInArrow(search, schema)
    best = W.partitionBy("id_a").orderBy(F.round("distance", 9), "id_b")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)


def conflicts(new: DataFrame, stored: DataFrame, at_least: float = 0.92, limit: int = 5, key: str = "vec_id") -> DataFrame:
    """For each new vector the nearest stored others with 1 - L2 at or over the bound, at most `limit` each."""
    near = near_in_blocks(new, stored, 1 - at_least, limit, key)
    return near.select("id_a", "id_b", (1 - F.col("distance")).alias("similarity"), "place")


def nearest_earlier(new: DataFrame, stored: DataFrame, within: float, key: str = "vec_id") -> DataFrame:
    """id, nearest: the distance of a new vector to the nearest stored one of a smaller key, where it is under the bound."""
    near = near_in_blocks(new, stored, within, 1, key, earlier=True)
    return near.where(F.col("distance") < within).select(F.col("id_a").alias("id"), F.col("distance").alias("nearest"))
