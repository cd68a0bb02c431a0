"""Harvesting helpers: commit subjects, ranges, batches for a model, JSON in prose."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words in a commit subject that mark it as routine or as the sign of a failure.
FORMATTERS = ["prettier", "eslint", "gofmt", "cargo fmt", "rustfmt", "black", "isort", "rubocop", "stylelint", "clang-format", "yapf", "autopep8", "swiftformat", "ktlint"]
ROUTINE = ["format code", "formatting", "fix whitespace", "whitespace", "trailing whitespace", "lint fix", "ran linter", "apply linting", "merge branch ", "merge pull request",
           "merge remote-tracking", "bump version", "version bump", "release v", "chore: release", "update changelog", "update lock", "cargo.lock"]
REVERTS = ['revert "', "revert: ", "revert "]
FAILURES = ["fix(", "fix!(", "fix: ", "fix!: ", "bug: ", "bug(", "bugfix", "hotfix", "regression", "crash", "broken", "broke", "incorrect", "wrong ", "oops", "mistake", "error: ", "panic",
            "deadlock", "memory leak", "data loss", "data corruption", "infinite loop", "stack overflow"]


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def routine_subject(subject: Column) -> Column:
    return _any(F.lower(F.trim(subject)), FORMATTERS + ROUTINE)


def failure_subject(subject: Column) -> Column:
    s = F.lower(F.trim(subject))
    starts = F.lit(False)
    for w in REVERTS:
        starts = starts | s.startswith(w)
    return starts | _any(s, FAILURES)


def range_count(text: Column, commits: Column) -> Column:
    """N of HEAD~N..HEAD, at most the number of commits there are; null for any other range."""
    n = F.nullif(F.regexp_extract(text, r"^HEAD~(\d{1,9})\.\.HEAD$", 1), F.lit("")).cast("int")
    return F.when(n.isNotNull(), F.when(commits > 0, F.least(n, commits)).otherwise(n))


def next_batch_len(tokens: Column, per_token: float, target_seconds: float, previous: int, ceiling: int = 256, growth: int = 8) -> Column:
    """How many leading items fit the target time at a rate: at least one, at most `growth` times the last batch."""
    cap = min(max(1, previous) * growth, max(1, ceiling))
    if per_token <= 0:
        return F.least(F.lit(cap), F.greatest(F.lit(1), F.size(tokens)))
    room = target_seconds / per_token
    fold = F.aggregate(F.slice(tokens, 1, cap), F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(False).alias("full")), lambda s, x: F.struct(
        F.when(s.full | ((s.n > 0) & (s.sum + F.greatest(x, F.lit(1)) > room)), s.n).otherwise(s.n + 1).alias("n"),
        (s.sum + F.greatest(x, F.lit(1))).cast("double").alias("sum"), (s.full | ((s.n > 0) & (s.sum + F.greatest(x, F.lit(1)) > room))).alias("full")))
    return F.greatest(F.lit(1), fold.n)


def first_items(rows: DataFrame, by: str, order: str, item: Column, most: int, into: str) -> DataFrame:
    """by, into: the first `most` items of each key in order, as an array. The limit is applied before the shuffle too."""
    place = F.row_number().over(W.partitionBy(by).orderBy(order))
    top = rows.select(by, F.col(order), item.alias("__i")).withColumn("__p", place).where(F.col("__p") <= most)
    return top.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__i"))), lambda x: x["__i"]).alias(into))


def capped_sessions(turns: DataFrame, session: str, order: str, text: str, limit: int, mark: str) -> DataFrame:
    """session, text: a session's turns in order, blank lines between; beyond `limit` bytes cut between characters and marked.

    No more turns than can fill the limit are gathered; the full length is a plain sum. Sessions of which a turn holds a
    secret, and blank ones, are left out.
    """
    from cairnset.functions.text import has_secret, truncate_bytes

    held = turns.groupBy(session).agg(F.max(has_secret(F.coalesce(text, F.lit("")))).alias("secret"), F.max(F.trim(F.coalesce(text, F.lit(""))) != "").alias("said"))
    turns = turns.join(held.where("said and not secret").select(session), session, "left_semi")
    body = first_items(turns, session, order, F.coalesce(text, F.lit("")), limit // 2 + 2, "__t")
    length = turns.groupBy(session).agg((F.sum(F.octet_length(F.coalesce(text, F.lit("")))) + 2 * (F.count(F.lit(1)) - 1)).alias("__n"))
    joined = body.join(length, session).withColumn("__x", F.array_join("__t", "\n\n"))
    return joined.select(session, F.when(F.col("__n") <= limit, F.col("__x")).otherwise(F.concat(truncate_bytes(F.col("__x"), limit), F.lit(mark))).alias("text"))


def harvested(candidates: DataFrame, stored: DataFrame, known_refs: DataFrame | None, within: float, key: str, per_round: int = 10_000) -> DataFrame:
    """key, verdict of candidates(key, embedding, source_ref) taken in one after the other, in the order of their keys.

    `harvested`: its source_ref is in `known_refs(source_ref)` or came with one taken in before; `similar`: nearer than `within` to a
    stored vector or to one taken in before; else `stored`, and later ones are compared with it. The distances to what is stored
    come from the block search; the candidates themselves, at most `per_round` of them in a task, are walked in order, and
    further rounds count those taken in before as stored. A null source_ref is none.
    """
    from cairnset.operators.notes import batches
    from cairnset.operators.retrieval import near_in_blocks
    from cairnset.session import cut

    kind = candidates.schema[key].dataType.simpleString()
    refs = known_refs.select("source_ref").distinct() if known_refs is not None else None
    ordered = cut(batches(candidates.select(key, "embedding", "source_ref"), [key], per_round))
    rounds, done = (ordered.agg(F.max("batch")).first()[0] or 0) + 1, None

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        taken, seen, out = [], set(), []
        for vector, ref, near, known in zip(pdf["embedding"], pdf["source_ref"], pdf["near"], pdf["known"]):
            x = np.asarray(vector, np.float64)
            if known or (ref is not None and ref in seen):
                out.append("harvested")
            elif near or (taken and np.sqrt(((np.stack(taken) - x) ** 2).sum(1)).min() < within):
                out.append("similar")
            else:
                out.append("stored")
                taken.append(x)
                seen.add(ref)
        return pd.DataFrame({key: pdf[key], "verdict": out})

    base = stored.select(key, "embedding")
    for i in range(rounds):
        part = ordered.where(F.col("batch") == i).drop("batch")
        close = near_in_blocks(part, base, within, 1, key).where(F.col("distance") < within).select(F.col("id_a").alias(key), F.lit(True).alias("near"))
        rows = part.join(close, key, "left")
        rows = rows.join(refs.withColumn("known", F.lit(True)), "source_ref", "left") if refs is not None else rows.withColumn("known", F.lit(None).cast("boolean"))
        rows = rows.select(key, "embedding", "source_ref", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("known", F.lit(False)).alias("known"))
        verdict = rows.groupBy(F.lit(0).alias("all")).applyInPandas(walk, f"{key} {kind}, verdict string")
        if rounds == 1:
            return verdict
        verdict = cut(verdict)
        fresh = part.join(verdict.where("verdict = 'stored'"), key)
        base = base.unionByName(fresh.select(key, "embedding"))
        new_refs = fresh.select("source_ref").where("source_ref is not null")
        refs = new_refs.distinct() if refs is None else refs.union(new_refs).distinct()
        done = verdict if done is None else done.union(verdict)
    return done


def blend_rate(old: tuple[int, float], sample: float) -> tuple[int, float]:
    """(samples seen, rate): the first seeds, the second takes nine tenths, later ones half."""
    n, rate = old
    return n + 1, sample if n == 0 else 0.1 * rate + 0.9 * sample if n == 1 else (rate + sample) / 2


def moving_rate(samples: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, rate after all samples of a key in order.

    Rows are dealt by ranges of (key, order), so a key of any size lies in as many tasks as it needs. A task gives for each of its
    keys the first two samples and what the later ones make of a rate before them, one linear step after the other: rate * a + b.
    Those few rows of a key are put together in order. Null values are left out.
    """
    kind = samples.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, part int, n long, v1 double, v2 double, a double, b double"

    def steps(frames):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}
        for pdf in frames:
            for k, v in zip(pdf[by].tolist(), pdf[value].tolist()):
                h = held.setdefault(k, [0, None, None, 1.0, 0.0])
                h[0] += 1
                if h[0] <= 2:
                    h[h[0]] = v
                else:
                    h[3], h[4] = h[3] / 2, (h[4] + v) / 2
            done = list(held)[:-1]  # rows are sorted: only the last key may go on
            yield pd.DataFrame([(k, part, *held.pop(k)) for k in done], columns=[by, "part", "n", "v1", "v2", "a", "b"])
        yield pd.DataFrame([(k, part, *h) for k, h in held.items()], columns=[by, "part", "n", "v1", "v2", "a", "b"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        state = (0, 0.0)
        for n, v1, v2, a, b in pdf.sort_values("part", kind="stable")[["n", "v1", "v2", "a", "b"]].itertuples(index=False):
            for v in [v1, v2][: int(n)]:
                state = blend_rate(state, v)
            state = (state[0] + max(0, int(n) - 2), state[1] * a + b)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "rate": [state[1]]})

    rows = samples.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, order, F.col(value).cast("double").alias(value))
    dealt = rows.repartitionByRange(by, order).sortWithinPartitions(by, order)
    return dealt.mapInPandas(steps, schema).groupBy(by).applyInPandas(join, f"{by} {kind}, rate double")


def split_to_fit(sizes: list[int], context: int) -> list[int]:
    """Lengths of the batches a list of byte sizes is halved into until a third of its bytes and its reply fit the context."""
    n = len(sizes)
    reply = min(max(400 * n, 256), context // 2)
    if n > 1 and sum(sizes) // 3 + reply > context:
        return split_to_fit(sizes[: n // 2], context) + split_to_fit(sizes[n // 2:], context)
    return [n]


def model_batches(rows: DataFrame, key: str, text: str, per_batch: int, context: int) -> DataFrame:
    """key, batch, part: batches of `per_batch` rows in key order, halved until they fit a model's context."""
    from cairnset.operators.notes import batches

    sized = rows.select(key, F.octet_length(F.coalesce(text, F.lit(""))).alias("bytes"))
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, batch long, part int"

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        part = [i for i, n in enumerate(split_to_fit(pdf["bytes"].tolist(), context)) for _ in range(n)]
        return pdf.assign(part=part)[[key, "batch", "part"]]

    return batches(sized, [key], per_batch).groupBy("batch").applyInPandas(cut, schema)


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text, or None."""
    start = (text or "").find("{")
    if start < 0:
        return None
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[start:i + 1]
    return None


def json_object(text: Column) -> Column:
    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(first_object, na_action="ignore")

    return find(text)


def tool_call(text: Column) -> Column:
    """(tool, argument) of a call written as JSON in prose: null unless it is one of the known tools."""
    obj = json_object(text)
    call = F.from_json(obj, "struct<tool:string,query:string,symbol:string,chunk_id:string,path:string,answer:string>", {"mode": "PERMISSIVE"})
    arg = F.coalesce(call.query, call.symbol, call.chunk_id, call.path, call.answer)
    return F.when(call.tool.isin("search", "graph", "read_chunk", "read_file", "done"), F.struct(call.tool.alias("tool"), arg.alias("argument")))
