"""Walking file trees: ordered exclude rules, sensitive names, recognised kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.functions import text as T

# Patterns left out by default, in the form of ignore files.
DEFAULT_EXCLUDES = [
    "package-lock.json", "npm-shrinkwrap.json", "packages.lock.json", "*.min.js", "*.min.css", "vendor/", "node_modules/", "third_party/", "dist/", "generated/", "__generated__/",
    "*.generated.*", "*.gen.go", "*.gen.ts", "zz_generated*.go", "*.pb.go", "*.pb.cc", "*.pb.h", "*_pb2.py", "*_pb2_grpc.py", "*_pb.js", "*_pb.d.ts", "schema.json", "*.schema.json",
    "**/translations/**/*.json", "**/locales/**/*.json", "**/locale/**/*.json", "**/i18n/**/*.json"]
# Our own list of names that may hold credentials.
SENSITIVE = r"(^|/)(\.env(\..*)?|.*\.(pem|key|p12|pfx|jks|keystore|kdbx)|id_(rsa|dsa|ecdsa|ed25519)(\..*)?|\.netrc|\.npmrc|\.pypirc|\.htpasswd|credentials(\..*)?|secrets?\.(json|ya?ml|toml)|.*\.tfstate(\..*)?)$"


def glob_regex(pattern: str) -> str:
    """An ignore-file pattern as an anchored expression over a whole path; directories end in a slash."""
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    anchored = "/" in body or pattern.startswith("/")
    return ("^" if anchored else "^(?:.*/)?") + out + ("/$" if pattern.endswith("/") else "/?$")


def compile_rules(patterns: list[str]) -> list[tuple[str, str, bool]]:
    """(pattern, expression, keeps) in order; `!` keeps again. Blank lines and comments are no rules."""
    return [(p, glob_regex(p.lstrip("!")), p.startswith("!")) for p in patterns if p.strip() and not p.startswith("#")]


def decide(path: Column, patterns: list[str], own: list[tuple[str, list[str]]] = ()) -> Column:
    """The pattern that excludes a path, or `keep`: of the rules that match a path the last one wins.

    A path is judged from its outermost directory inwards, and what lies in an excluded directory cannot be kept again. `own`:
    further rules as (directory, patterns), outer directories first, which hold below their directory only.
    """
    rules = compile_rules(patterns)
    for folder, more in own:
        rules += [(p, "^" + re.escape(folder) + rx[1:], keeps) for p, rx, keeps in compile_rules(more)]

    def judge(p: Column) -> Column:
        out = F.lit("keep")
        for pattern, rx, keeps in rules:
            out = F.when(p.rlike(rx), F.lit("keep" if keeps else pattern)).otherwise(out)
        return out

    steps = F.split(path, "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.when(i < F.size(steps), "/").otherwise("")))
    return F.coalesce(F.try_element_at(F.filter(F.transform(parents, judge), lambda x: x != "keep"), F.lit(1)), F.lit("keep"))


def tree_rules(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore", ".ignore"), depth: int = 16) -> list[tuple[str, list[str]]]:
    """The rules of the ignore files of a tree, down to a depth: (directory with a closing slash, patterns), outer ones first."""
    jvm, out = spark._jvm, []
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/")
    for level in range(depth + 1):
        for name in names:
            for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(base + "/*" * level + "/" + name)) or []:
                where = status.getPath().toString()
                stream = fs.open(status.getPath())  # one configuration file; readers of tables skip hidden names
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                out.append((where[len(base) + 1:-len(name)], [x.rstrip() for x in text.splitlines()]))
    return out


def size_gate(n_bytes: Column, most: int = 64 << 20, parsed: int = 512 << 10) -> Column:
    """skip beyond the largest file read, windows beyond the largest that is taken apart by its syntax, else parse."""
    return F.when(n_bytes > most, "skip").when(n_bytes > parsed, "windows").otherwise("parse")


def walkable(path: Column) -> Column:
    return ~F.lower(path).rlike(SENSITIVE) & T.lang_detect(path).isNotNull()


def read_tree(spark: SparkSession, root: str, patterns: list[str] | None = None, max_bytes: int = 64 << 20, max_rules: int = 5_000) -> DataFrame:
    """path, size, language, text of the files under a root that pass the rules and its ignore files; large and binary ones left out."""
    own = tree_rules(spark, root)
    if sum(len(p) for _, p in own) > max_rules:
        raise ValueError(f"more than {max_rules} ignore rules: index the tree part by part")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base) + "/", "")
    kept = raw.where(F.col("length") <= max_bytes).select(path.alias("path"), F.col("length").alias("size"), F.col("content").alias("bytes"))
    fit = kept.where(walkable(F.col("path")) & (decide(F.col("path"), patterns if patterns is not None else DEFAULT_EXCLUDES, own) == "keep"))
    text = F.col("bytes").cast("string")
    return fit.select("path", "size", T.lang_detect(F.col("path")).alias("language"), text.alias("text")).where(~T.is_binary(F.col("text")))
