"""Source files nobody wrote by hand in their project: generated, minified, vendored, or data saved as code.

Vendored copies are found by winnowing: the token stream of a file (lower case, white space dropped) is hashed in k-grams,
the least hash of every window of w k-grams is kept as a fingerprint, so two files that share k + w - 1 tokens in a row share a
fingerprint wherever it lies. A fingerprint that occurs in at least `min_projects` projects recurs. Fingerprints weigh the
logarithm of files over files that have them, so runs common to much code count little; a file is a copy if recurring ones make up
`min_share` of its weight, which leaves room for local changes. A file with fewer than `MIN_PRINTS` fingerprints has too few
for a share: it is compared by its whole token stream, so only whole copies of it are found. Copies also show in their place
(vendor directories, versioned file names) and in a header naming the release they were taken from. Generated files show by a
comment at their head or by the file name their tool gives them; minified files by their density (hardly any white space, lines
far longer than anyone writes); data by literals making up nearly all of the text.

A file is read in segments of `SEGMENT` chunks, so that a file of any length is spread over tasks; fingerprints do not
span segments. Null content counts as empty, chunks sent again count once, files without chunks are judged by their path.
All thresholds are parameters or fixed values below and the same for every input size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnset.llm import tokens as K
from cairnset.llm.splitting import current_files
from cairnset.session import cut, salted_join

SEGMENT, KGRAM, WINDOW, MIN_PRINTS, HEAD_LINES = 256, 70, 30, 6, 20

# What tools write into files and names, and where copies are kept.
_LEAD = r"^[\s/*#;<!\-%\"'(]*"
GENERATED_LINE = re.compile(
    _LEAD + r"((this|the following)( file| code| source)?( was| is| has been)? )?"
    r"(@generated\b|code generated (by|from)\b.*do not (edit|modify)|auto-?generated\b|automatically generated\b|generated automatically\b"
    r"|generated at (build|compile) time\b|generated by\b.*(do not (edit|modify)|overwritten|will be lost)"
    r"|(is )?(a )?machine[- ](written|generated|made)\b|(\S+: )?output of `[^`]+`.*\b(template|not here|do not)"
    r"|automatisch (erzeugt|generiert|erstellt)\b|g[ée]n[ée]r[ée] automatiquement\b|(archivo )?generado autom[áa]ticamente\b"
    r"|автоматически (сгенерирован|создан)|自動生成)", re.I)
TEMPLATE = re.compile(r"%[sdv]|\{\w*\}|\$\{|<%|banner template", re.I)
COPIED_LINE = re.compile(
    _LEAD + r"(bundled copy of \S+|vendored (copy )?(of|from) \S+|imported verbatim from\b|copied verbatim from\b|\S+ v?\d+(\.\d+)+ +--? +upstream copy\b)", re.I)
GENERATED_PATH = (
    r"(\.(generated|gen|g|pb|designer)\.[a-z]+$)|(\.pb-c\.[ch]$)|(_pb2(_grpc)?\.pyi?$)|(_pb\.(js|ts|d\.ts|rb)$)|(\.pb\.(go|cc|h|rs|swift|dart)$)"
    r"|((^|/)zz_generated\.)|((^|/)(__generated__|generated|autogen|gen-src)/)")
VENDORED_PATH = (
    r"(^|/)(node_modules|bower_components|jspm_packages|third_party|third-party|thirdparty|3rdparty|vendor|_vendor|vendored|external|externals"
    r"|site-packages|pods|carthage|deps/bundled|godeps/_workspace)/|(^|/)[a-z][a-z0-9_]*-v?\d+\.\d+\.\d+[-.][^/]*$")
_STRING = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|0[xX][0-9a-fA-F]+")
_IDENT = re.compile(r"[^\W\d]\w*")
_FEATURES = ("file_id long, segment int, n long, spaces long, lines long, wide long, marks long, idents long, literal boolean, "
             "generated boolean, copied boolean, prints array<long>, tokens long, whole long")


def fingerprints(hashes: np.ndarray, k: int = KGRAM, w: int = WINDOW) -> np.ndarray:
    """Distinct winnowed k-gram hashes of a token stream; none if it is shorter than k."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    start = np.arange(len(hashes) - k + 1)
    grams = K.span_hashes(hashes, start, start + k)
    if len(grams) > w:  # sliding minimum by doubling
        low, span = grams, 1
        while 2 * span <= w:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span:])
        grams = low
    else:
        grams = grams.min(keepdims=True)
    return np.unique(grams)


def features(text: str, first: bool) -> tuple:
    cp = K.codepoints(text)
    ascii_ = cp[cp < 128]
    count = np.bincount(ascii_, minlength=128)
    spaces = int(count[[9, 10, 11, 12, 13, 32]].sum())
    digits, letters = int(count[48:58].sum()), int(count[65:91].sum() + count[97:123].sum() + count[95])
    start, end, h = K.words(cp)
    runs = int((end - start)[end - start >= 60].sum())
    n = len(cp)
    literal = digits >= 0.08 * n or runs >= 0.3 * n
    idents = sum(map(len, _IDENT.findall(_STRING.sub(" ", text)))) if literal else n
    head = text.split("\n", HEAD_LINES)[:HEAD_LINES] if first else []
    return (
        n, spaces, int(count[10]) + 1, n - len(ascii_), len(ascii_) - spaces - digits - letters, idents, bool(literal),
        any(GENERATED_LINE.match(x) and not TEMPLATE.search(x) for x in head), any(COPIED_LINE.match(x) for x in head),
        fingerprints(h).view(np.int64).tolist(), len(h),
        int(K.span_hashes(h, np.array([0]), np.array([len(h)])).view(np.int64)[0]) if len(h) else None)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 6 + [pa.bool_()] * 3 + [pa.list_(pa.int64())] + [pa.int64()] * 2
    names = ["n", "spaces", "lines", "wide", "marks", "idents", "literal", "generated", "copied", "prints", "tokens", "whole"]
    for b in batches:
        col = lambda c: b.column(b.schema.get_field_index(c))
        rows = [features(t or "", s == 0) for t, s in zip(col("text").to_pylist(), col("segment").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [col("file_id"), col("segment"), *[pa.array(list(x), t) for x, t in zip(zip(*rows), types)]] if rows else
            [col("file_id"), col("segment"), *[pa.array([], t) for t in types]], names=["file_id", "segment", *names])


def segment_features(chunks: DataFrame) -> DataFrame:
    """Measures, head marks and fingerprints of each segment of each file."""
    part = F.struct(F.col("seq"), F.col("chunk_id"), F.coalesce("content", F.lit("")).alias("content"))
    rows = chunks.where("file_id is not null").select("file_id", F.floor(F.coalesce("seq", F.lit(0)) / SEGMENT).cast("int").alias("segment"), part.alias("part"))
    texts = rows.groupBy("file_id", "segment").agg(F.array_sort(F.array_distinct(F.collect_list("part"))).alias("parts"))
    joined = texts.select(F.col("file_id").cast("long").alias("file_id"), "segment", F.array_join(F.transform("parts", lambda x: x.content), "\n").alias("text"))
    return joined.mapInArrow(_read, _FEATURES)


def recurring_share(prints: DataFrame, min_projects: int, n_files: int) -> DataFrame:
    """prints(file_id, project, fp) to file_id, prints, share of their weight that recurs: counted over all files of all projects."""
    once = prints.distinct()
    spread = once.groupBy("fp", "project").agg(F.count(F.lit(1)).alias("files")).groupBy("fp").agg(F.count("project").alias("projects"), F.sum("files").alias("files"))
    known = salted_join(once, spread.where("files > 1"), "fp", "left")
    weight = F.log(F.lit(float(max(2, n_files))) / F.coalesce("files", F.lit(1)))
    return known.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("prints"), F.count(F.when(F.col("projects") >= min_projects, 1)).alias("recurring"),
        (F.sum(F.when(F.col("projects") >= min_projects, weight).otherwise(0.0)) / F.sum(weight)).alias("share"))


def whole_files(parts: DataFrame) -> DataFrame:
    """file_id, fp: one fingerprint of the whole token stream of each file that has tokens."""
    wholes = F.array_sort(F.collect_list(F.when(F.col("whole").isNotNull(), F.struct("segment", "whole"))))
    files = parts.groupBy("file_id").agg(F.sum("tokens").alias("tokens"), wholes.alias("wholes"))
    return files.where("tokens > 0").select("file_id", F.xxhash64(F.transform("wholes", lambda x: x.whole)).alias("fp"))


def not_by_hand(files: DataFrame, chunks: DataFrame, min_projects: int = 3, min_share: float = 0.5) -> DataFrame:
    """file_id, project, path, language and why: one flag per reason, for every file."""
    parts = cut(segment_features(chunks))
    known = cut(current_files(files))
    whole = parts.groupBy("file_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "spaces", "lines", "wide", "marks", "idents")],
        *[F.max(c).alias(c) for c in ("literal", "generated", "copied")])
    prints = parts.select("file_id", F.explode("prints").alias("fp")).join(known.select("file_id", "project"), "file_id")
    n_files = known.count()
    shares = recurring_share(prints, min_projects, n_files)
    short = recurring_share(whole_files(parts).join(known.select("file_id", "project"), "file_id"), min_projects, n_files).select(
        "file_id", (F.col("recurring") > 0).alias("repeated"))
    path, size = F.lower(F.coalesce("path", F.lit(""))), F.greatest("n", F.lit(1))
    prose = path.rlike(r"\.(md|markdown|rst|txt|adoc)$")
    dense = (F.col("spaces") < 0.06 * size) & (F.col("n") > 100 * F.col("lines")) & (F.col("wide") < 0.2 * size) & (F.col("marks") > 0.15 * size)
    off = lambda c: F.coalesce(c, F.lit(False))
    return known.join(whole, "file_id", "left").join(shares, "file_id", "left").join(short, "file_id", "left").select(
        "file_id", "project", "path", "language",
        off(F.col("generated") | path.rlike(GENERATED_PATH)).alias("generated"),
        off(dense & (F.col("n") >= 200) & ~prose).alias("minified"),
        off(F.col("copied") | path.rlike(VENDORED_PATH)
            | F.when(F.coalesce("prints", F.lit(0)) < MIN_PRINTS, F.col("repeated")).otherwise(F.col("share") >= min_share)).alias("vendored"),
        off(F.col("literal") & (F.col("n") >= 200) & (F.col("idents") < 0.05 * size) & ~prose).alias("data"))
