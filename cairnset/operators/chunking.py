"""Cutting files into chunks: line windows, markdown sections, notebook cells, Python definitions."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnset.functions import text as T

CAP_TOKENS = 512
WINDOWS = "array<struct<start_line:int,end_line:int,content:string>>"


def source_lines(text: str) -> list[str]:
    """Lines without their ends; a final line end opens no further line."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def line_windows(text: str, cap_tokens: int = CAP_TOKENS) -> list[tuple[int, int, str]]:
    """(first line, last line, content): whole lines up to four characters a token, an eighth of that shared with the next."""
    lines = source_lines(text)
    budget = 4 * cap_tokens
    total = [0]
    for x in lines:
        total.append(total[-1] + len(x) + 1)
    out, start = [], 0
    while start < len(lines):
        end = start + 1
        while end < len(lines) and total[end + 1] - total[start] - 1 <= budget:
            end += 1
        out.append((start + 1, end, "\n".join(lines[start:end])))
        if end == len(lines):
            break
        back = end
        while back > start + 1 and total[end] - total[back - 1] <= budget // 8:
            back -= 1
        start = back
    return out


def sliding_window(content: Column, cap_tokens: int = CAP_TOKENS) -> Column:
    """Array of windows of a text, computed in Arrow batches (each cut depends on the one before)."""

    @F.pandas_udf(WINDOWS)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start_line": a, "end_line": b, "content": c} for a, b, c in line_windows(t or "", cap_tokens)] for t in texts])

    return cut(content)


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start_line, end_line, name, content of each heading's section (what precedes the first has no name).

    The text is split in place before each heading line, so no line ever leaves its document: no explode of lines, no shuffle.
    Blank sections are dropped.
    """
    lined = docs.select(key, F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n\\z", "").alias("t"))
    parts = lined.select(key, F.split("t", r"(?m)^(?=#{1,6}(?: |$))").alias("s"))
    breaks = F.transform("s", lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"), F.lit(""))))
    # a running count over the sections, so no section is read again for those behind it
    first_lines = F.aggregate(breaks, F.array(F.lit(1)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    each = parts.select(key, F.size("s").alias("n"), F.posexplode(F.arrays_zip("s", F.slice(first_lines, F.lit(1), F.size("s")).alias("l"))).alias("i", "z")).select(
        key, F.col("z.l").alias("start_line"),
        F.when(F.col("i") < F.col("n") - 1, F.regexp_replace("z.s", "\n\\z", "")).otherwise(F.col("z.s")).alias("content"))
    first = F.substring_index("content", "\n", 1)
    return each.where(F.trim(F.regexp_replace("content", r"\s", "")) != "").select(
        key, "start_line", (F.col("start_line") + F.size(F.split("content", "\n")) - 1).alias("end_line"), T.atx_heading(first).alias("name"), "content")


def markdown_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", cap_tokens: int = CAP_TOKENS) -> DataFrame:
    """Sections, those over the token cap cut into windows (kind verbatim); a document without any: windows of the whole."""
    sections = markdown_sections(docs, key, text)
    big = T.tok_estimate(F.col("content")) > cap_tokens
    whole = sections.where(~big).select(key, "start_line", "end_line", "name", F.lit("section").alias("kind"), "content")
    cut = sections.where(big).select(key, "start_line", "name", F.explode(sliding_window(F.col("content"), cap_tokens)).alias("w"))
    windows = cut.select(key, (F.col("start_line") + F.col("w.start_line") - 1).alias("start_line"), (F.col("start_line") + F.col("w.end_line") - 1).alias("end_line"), "name", F.lit("verbatim").alias("kind"), "w.content")
    return whole.unionByName(windows)


def notebook_cells(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-blank cells with running line numbers; markdown and raw cells are sections, others carry the kernel's language."""
    schema = "struct<cells:array<struct<cell_type:string,source:string>>,metadata:struct<kernelspec:struct<language:string>>>"
    nb = docs.select(key, F.from_json(text, schema).alias("nb")).where("nb.cells is not null")
    joined = F.transform("nb.cells", lambda c, i: F.struct(
        (i + 1).alias("n"), c.cell_type.alias("cell_type"),
        # a source is a string or an array of lines, which arrives as its JSON text
        F.coalesce(F.array_join(F.from_json(c.source, "array<string>", {"mode": "PERMISSIVE"}), ""), c.source).alias("content")))
    kept = nb.select(key, F.coalesce(F.nullif(F.col("nb.metadata.kernelspec.language"), F.lit("")), F.lit("python")).alias("kernel"),
                     F.filter(joined, lambda c: F.trim(F.regexp_replace(c.content, r"\s", "")) != "").alias("cells"))
    n_lines = lambda c: F.greatest(F.lit(1), F.size(F.split(F.regexp_replace(c, "\n\\z", ""), "\n")))
    lines = F.aggregate(F.transform("cells", lambda c: n_lines(c.content)), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    each = kept.select(key, "kernel", F.explode(F.arrays_zip("cells", F.slice(lines, F.lit(1), F.size("cells")).alias("before"))).alias("z")).select(
        key, "kernel", F.col("z.cells").alias("c"), F.col("z.before").alias("before"))
    before = F.col("before")
    prose = F.col("c.cell_type").isin("markdown", "raw")
    return each.select(
        key, F.concat(F.lit("cell "), F.col("c.n").cast("string")).alias("name"), (before + 1).alias("start_line"), (before + n_lines(F.col("c.content"))).alias("end_line"),
        F.when(prose, "section").otherwise("verbatim").alias("kind"), F.when(prose, "markdown").otherwise(F.col("kernel")).alias("language"), F.col("c.content").alias("content"))


def _definitions(text: str) -> list[tuple]:
    """(kind, name, scope, first line, last line, docstring) of every function and class; none if the text does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out, todo = [], [(tree, None)]
    while todo:
        node, scope = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                first = min([child.lineno, *[x.lineno for x in child.decorator_list]])
                out.append((kind, child.name, scope, first, child.end_lineno, ast.get_docstring(child)))
                todo.append((child, child.name))
            else:
                todo.append((child, scope))
    return sorted(out, key=lambda x: (x[3], -x[4]))


def python_definitions(files: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """Definitions of Python sources by their syntax tree; texts that do not parse fall back to line windows."""
    schema = files.select(key).schema.simpleString()[7:-1].replace(":", " ") + ", kind string, name string, parent_scope string, start_line int, end_line int, docstring string"

    def run(frames):
        for pdf in frames:
            rows = []
            for k, t in zip(pdf[key].tolist(), pdf[text].tolist()):
                found = _definitions(t or "")
                rows += [(k, *x) for x in found] or [(k, "verbatim", None, None, a, b, None) for a, b, _ in line_windows(t or "")]
            yield pd.DataFrame(rows, columns=[key, "kind", "name", "parent_scope", "start_line", "end_line", "docstring"])

    return files.select(key, text).mapInPandas(run, schema)
