"""Convention mining: naming, documentation, error handling, async and testing habits by language.

One aggregate over the chunks counts everything; records are projections of that one row per language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnset.functions import text as T

STYLES = ["snake_case", "camelCase", "PascalCase", "SCREAMING_SNAKE_CASE"]  # in order of preference on equal counts
# Kinds of chunks, words looked for and what their records say.
CALLABLE, TYPES = ["function", "method"], ["class", "struct", "enum", "trait", "interface", "type"]
RUST_ERRORS = [("anyhow", "Error handling via anyhow::Result"), ("thiserror", "Error types defined with thiserror"), ("AppError", "Custom AppError type for error handling")]
_TS_TEST = r"(\.(test|spec)\.tsx?$)|(__tests__/)"


def has_doc_prefix(content: Column) -> Column:
    c = F.regexp_replace(content, r"^\s+", "")
    return F.coalesce(c.rlike(r"^(///|//!|/\*\*|/\*!|\"\"\"|'''|\* )"), F.lit(False))


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def language_counts(chunks: DataFrame) -> DataFrame:
    """chunks(language, node_type, name, content, path): all counts of a language in one row; tsx counts as typescript."""
    lang = F.when(F.col("language") == "tsx", "typescript").otherwise(F.col("language"))
    c, style = F.col("content"), T.case_style(F.col("name"))
    call, kind = F.col("node_type").isin(CALLABLE), F.col("node_type").isin(TYPES)
    rust, ts = lang == "rust", lang == "typescript"
    aggs = [_n(call & (style == s)).alias(f"f{i}") for i, s in enumerate(STYLES)] + [_n(kind & (style == s)).alias(f"t{i}") for i, s in enumerate(STYLES)]
    aggs += [_n(c.rlike(rf"\b{w}\b") & rust).alias(f"e{i}") for i, (w, _) in enumerate(RUST_ERRORS)]
    aggs += [
        _n(call).alias("callables"), _n(call & has_doc_prefix(c)).alias("documented"), _n(call & ((rust & c.rlike(r"\basync\s+fn\b")) | (ts & c.rlike(r"\basync\b")))).alias("asyncs"),
        F.max(c.rlike(r"\btokio::") & rust).alias("tokio"), _n(rust & F.col("path").rlike(r"(_test\.rs$)|(tests/)")).alias("test_files"), _n(rust & c.rlike(r"#\s*\[cfg\s*\(\s*test\s*\)\]")).alias("cfg_tests"),
        _n(ts & F.col("path").rlike(_TS_TEST)).alias("ts_tests")]
    return chunks.where("language is not null").groupBy(lang.alias("language")).agg(*aggs)


def _record(category: str, description: Column, confidence: Column, evidence: Column, when: Column, source: int = 0) -> Column:
    return F.when(when, F.struct(F.lit(category).alias("category"), description.cast("string").alias("description"), confidence.cast("double").alias("confidence"), evidence.cast("long").alias("evidence_count"), F.lit(source).alias("source")))


def _naming(category: str, what: str, prefix: str, when: Column, source: int) -> Column:
    best = F.array_max(F.array(*[F.struct(F.col(f"{prefix}{i}").alias("n"), F.lit(-i).alias("prio"), F.lit(s).alias("style")) for i, s in enumerate(STYLES)]))
    total = sum((F.col(f"{prefix}{i}") for i in range(len(STYLES))), F.lit(0))
    return _record(category, F.concat(F.lit(what + " use "), best.style), best.n / total, best.n, when & (total > 0), source)


def records(counts: DataFrame) -> DataFrame:
    """All candidate records of each language: source 0 of its own rules, 1 of the rules for every language."""
    rust, ts = F.col("language") == "rust", F.col("language") == "typescript"
    own = rust | ts
    docs = F.col("documented") / F.col("callables")
    level = F.when(docs > 0.7, "high").when(docs >= 0.3, "medium").otherwise("low")
    sure = F.when(docs > 0.7, docs).when(docs >= 0.3, F.greatest(docs, F.lit(0.5))).otherwise(F.greatest(1 - docs, F.lit(0.5)))
    share = F.col("asyncs") / F.col("callables")
    errs = F.array_max(F.array(*[F.struct(F.col(f"e{i}").alias("n"), F.lit(-i).alias("prio"), F.lit(t).alias("text")) for i, (_, t) in enumerate(RUST_ERRORS)]))
    n_errs = sum((F.col(f"e{i}") for i in range(len(RUST_ERRORS))), F.lit(0))
    tests = F.greatest("test_files", "cfg_tests")
    found = [
        _naming("naming.functions", "Functions", "f", own, 0), _naming("naming.functions", "Functions", "f", F.lit(True), 1), _naming("naming.types", "Types", "t", own, 0),
        *[_record("docs", F.concat(F.lit("Doc comment coverage: "), level), sure, F.col("callables"), (F.col("callables") > 0) & w, s) for w, s in ((own, 0), (F.lit(True), 1))],
        _record("error_handling", errs.text, errs.n / n_errs, errs.n, n_errs > 0),
        _record("async", F.when(rust, F.concat(F.lit("Async runtime: "), F.when(F.col("tokio"), "tokio").otherwise("async-std"))).otherwise("async/await is widely used"), share, F.col("asyncs"), own & (share > 0.2)),
        _record("testing", F.when(F.col("test_files") >= F.col("cfg_tests"), "Tests in separate *_test.rs / tests/ files").otherwise("Tests in #[cfg(test)] inline modules"), tests / (F.col("test_files") + F.col("cfg_tests")), tests, tests > 0),
        _record("testing", F.lit("Tests in .test.ts / .spec.ts / __tests__/ files"), F.lit(1.0), F.col("ts_tests"), F.col("ts_tests") > 0)]
    return counts.select("language", F.explode(F.array_compact(F.array(*found))).alias("r")).select("language", "r.*")


def merged(all_records: DataFrame, least_confidence: float = 0.5, least_evidence: int = 5) -> DataFrame:
    """One record per language and category, a language's own rules first; weak ones dropped."""
    first = F.row_number().over(W.partitionBy("language", "category").orderBy("source"))
    kept = all_records.withColumn("rn", first).where("rn = 1").drop("rn", "source")
    return kept.where((F.col("confidence") >= least_confidence) & (F.col("evidence_count") >= least_evidence))
