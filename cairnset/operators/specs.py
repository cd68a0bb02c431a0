"""Specifications and the code they govern, by linked path prefixes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnset.session import cut, salted_join


#: About as many result rows, or characters of results, are made by one task.
TASK_ROWS, TASK_CHARS = 1 << 21, 1 << 26


def under_links(files: DataFrame, links: DataFrame, any_case: bool = False) -> DataFrame:
    """files(path, ...) beside the links(linked_path, ...) whose linked path starts theirs.

    A prefix join as an equality: each path is cut where a linked path of that length may end (a few dozen lengths, each with the
    characters that links of that length end in) and joined on the prefix, so no path meets a link it does not start with.
    Null paths and links match nothing.
    """
    fold = F.lower if any_case else (lambda c: F.col(c) if isinstance(c, str) else c)
    known = links.where("linked_path is not null").withColumn("__prefix", fold("linked_path")).distinct()
    last = known.select(F.char_length("__prefix").alias("n"), F.right("__prefix", F.lit(1)).alias("c")).groupBy("n").agg(F.array_join(F.collect_set("c"), "").alias("c"))
    ends = sorted(tuple(r) for r in last.collect())  # at most the length of the longest path
    may_end = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in ends]).cast("array<struct<n:int,c:string>>")
    at = lambda e: (e.n == 0) | ((e.n <= F.char_length("__folded")) & F.contains(e.c, F.substring(F.col("__folded"), e.n, F.lit(1))))
    cuts = files.where("path is not null").withColumn("__folded", fold("path"))
    cuts = cuts.withColumn("__n", F.explode(F.transform(F.filter(may_end, at), lambda e: e.n)))
    cuts = cuts.withColumn("__prefix", F.substring(F.col("__folded"), F.lit(1), F.col("__n")))
    return salted_join(cuts, known, "__prefix").drop("__prefix", "__n", "__folded")


def outermost(links: DataFrame, by: str) -> DataFrame:
    """links(by, linked_path), each once, without those that start with another one of the same owner: a path then meets one link of an owner at most."""
    own = links.where("linked_path is not null").select(by, "linked_path").distinct()
    known = own.select("linked_path").distinct()
    above = under_links(known.withColumnRenamed("linked_path", "path"), known).where("path <> linked_path").select(F.col("path").alias("linked_path"), F.col("linked_path").alias("__above"))
    inner = own.join(above, "linked_path").join(own.select(by, F.col("linked_path").alias("__above")), [by, "__above"], "left_semi")
    return own.join(inner.select(by, "linked_path"), [by, "linked_path"], "left_anti")


def _shares(sizes: DataFrame, key: str, most: int) -> tuple[DataFrame, int]:
    """The sub-keys that each key(key, made) is dealt over so that one makes about `most`, and the number of tasks for all."""
    total = sizes.agg(F.sum("made")).first()[0] or 0
    tasks = max(sizes.sparkSession.sparkContext.defaultParallelism, math.ceil(total / most))
    return sizes.select(key, F.greatest(F.lit(1), F.ceil(F.col("made") / most)).cast("int").alias("__salts")), tasks


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths(path) beside the longest of the registered roots(root) that starts theirs, null where none does."""
    hit = under_links(paths.select("path").distinct(), roots.where("root <> ''").select(F.lit(0).alias("spec_id"), F.col("root").alias("linked_path")))
    best = hit.groupBy("path").agg(F.max_by("linked_path", F.char_length("linked_path")).alias("root"))
    return paths.select("path").distinct().join(best, "path", "left")


def specs_for_files(files: DataFrame, specs: DataFrame, links: DataFrame, by: str = "spec_id") -> DataFrame:
    """path, spec_path, title of each specification that governs a file, each once; specs and links share the column `by` (the
    specification, or a group of specifications that are linked alike).

    The result may be as large as files by specifications, so it is made by the last join and not moved or compared: every pair
    of path and title has one owner (what several owners share belongs to the set of them), and a path meets an owner once.
    """
    own = cut(specs.select(by, F.col("path").alias("spec_path"), "title").groupBy("spec_path", "title").agg(F.sort_array(F.collect_set(by)).alias("__owner")))
    each = own.select("__owner").distinct().withColumn(by, F.explode("__owner"))
    roots = cut(outermost(links.join(each, by), "__owner"))
    hits = cut(under_links(files.select("path").distinct(), roots.select("linked_path").distinct()))
    met = hits.groupBy("linked_path").count().join(roots, "linked_path").groupBy("__owner").agg(F.sum("count").alias("files"))
    sizes = cut(met.join(own.groupBy("__owner").count(), "__owner").select("__owner", (F.col("files") * F.col("count")).alias("made")))
    shares, tasks = _shares(sizes, "__owner", TASK_ROWS)
    left = salted_join(hits, roots.join(shares, "__owner"), "linked_path").select("path", "__owner", F.pmod(F.xxhash64("path"), "__salts").cast("int").alias("__salt"))
    right = own.join(shares, "__owner").select("spec_path", "title", "__owner", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt"))
    key = ["__owner", "__salt"]
    return left.repartition(tasks, *key).join(right.repartition(tasks, *key), key).select("path", "spec_path", "title")


def governing_specs(files: DataFrame, specs: DataFrame, links: DataFrame, by: str = "spec_id") -> DataFrame:
    """files(path, ...) with governing_specs: the paths of the specifications that govern each, once, in order, joined by "|"; null
    where none does. specs and links share the column `by`.

    The linked paths that start a path are those that start the longest of them, and many longest ones have the same owners, so a
    list is made once for each set of owners and handed out by the last join.
    """
    own = cut(specs.where("path is not null").select(by, F.col("path").alias("spec_path")).distinct())
    roots = cut(links.where("linked_path is not null").join(own.select(by).distinct(), by, "left_semi").select(by, "linked_path").distinct())
    known = roots.select("linked_path").distinct()
    sets = under_links(known.withColumnRenamed("linked_path", "path"), roots).groupBy("path").agg(F.sort_array(F.collect_set(by)).alias("__owners"))
    sets = cut(sets.withColumnRenamed("path", "linked_path"))
    kinds = sets.groupBy("__owners").agg(F.min("linked_path").alias("__kind"))
    lists = kinds.select("__kind", F.explode("__owners").alias(by)).join(own, by).groupBy("__kind").agg(F.array_join(F.sort_array(F.collect_set("spec_path")), "|").alias("governing_specs"))
    lists = cut(lists)  # sized first, then handed out
    longest = under_links(files.select("path").distinct(), known).groupBy("path").agg(F.max_by("linked_path", F.char_length("linked_path")).alias("linked_path"))
    found = cut(salted_join(longest, sets.join(kinds, "__owners").select("linked_path", "__kind"), "linked_path").select("path", "__kind"))
    counts = files.join(found, "path").groupBy("__kind").count()
    sizes = cut(counts.join(lists, "__kind").select("__kind", (F.col("count") * F.char_length("governing_specs")).alias("made")))
    shares, tasks = _shares(sizes, "__kind", TASK_CHARS)
    left = files.join(salted_join(found, shares, "__kind"), "path", "left")
    left = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in files.columns]), F.coalesce("__salts", F.lit(tasks))).cast("int")).drop("__salts")
    right = lists.join(shares, "__kind").select("__kind", "governing_specs", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt"))
    key = ["__kind", "__salt"]
    return left.repartition(tasks, *key).join(right.repartition(tasks, *key), key, "left").drop(*key)


def stale_specs(files: DataFrame, specs: DataFrame, links: DataFrame) -> DataFrame:
    """Specifications whose linked code (prefix in any case) was indexed after they were: spec_id, spec_path, title, linked_path, both instants."""
    at = files.select(F.col("path").alias("spec_path"), F.col("indexed_at").alias("spec_indexed_at"))
    own = specs.select("spec_id", F.col("path").alias("spec_path"), "title").join(at, "spec_path")
    hit = under_links(files.select("path", F.col("indexed_at").alias("code_indexed_at")), links, any_case=True)
    return hit.join(own, "spec_id").where("code_indexed_at > spec_indexed_at").select(
        "spec_id", "spec_path", "title", "linked_path", "spec_indexed_at", "code_indexed_at").distinct()
