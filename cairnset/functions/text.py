"""Text expressions: everything here is a Column built from Catalyst built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_GAP = r"[^\p{L}\p{N}]+"

# Extensions and names by which files are recognised.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript",
    "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "json": "json",
    "html": "html", "htm": "html", "css": "css", "tf": "hcl", "hcl": "hcl", "php": "php", "phtml": "php", "rb": "ruby", "rake": "ruby", "gemspec": "ruby",
    "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "sql": "sql", "sequel": "sql", "proto": "proto", "pdf": "pdf"}
TEXT_LANGUAGES = {
    "md": "markdown", "mdx": "markdown", "markdown": "markdown", "rmd": "markdown", "qmd": "markdown", "txt": "text", "rst": "text", "adoc": "text",
    "asciidoc": "text", "ipynb": "notebook", "docx": "docx", "xlsx": "spreadsheet", "xls": "spreadsheet", "ods": "spreadsheet"}
TEXT_NAMES = ["README", "CHANGELOG", "CHANGES", "CONTRIBUTING", "NOTICE", "AUTHORS", "HISTORY"]
# Our own list of credential shapes.
SECRET_PATTERNS = [
    r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"(?i)(password|passwd|secret|api_key|token)\s*[:=]\s*['\"][^'\"\s]{8,}['\"]"]
# Phrases that try to steer a reader that is a model: (category, pattern), in order of precedence.
INJECTION_PATTERNS = [
    ("ignore_instructions", r"(?i)\bignore\s+(all\s+)?(previous\s+)?instructions\b"),
    ("you_are_now", r"(?i)\byou\s+are\s+now\b"),
    ("new_persona", r"(?i)\bact\s+as\b"),
    ("disregard", r"(?i)\bdisregard\s+(all\s+)?(previous\s+)?(instructions|context|rules)\b"),
    ("forget", r"(?i)\bforget\s+(everything|all\s+previous)\b"),
    ("system_prefix", r"(?im)^system\s*:"),
    ("role_override", r"(?i)\bnew\s+role\s*:"),
    ("jailbreak_sudo", r"(?i)\bDAN\b|\bdo\s+anything\s+now\b"),
    ("developer_mode", r"(?i)\bdeveloper\s+mode\b"),
    ("system_override", r"(?i)\bsystem\s+override\b"),
    ("reveal_prompt", r"(?i)\b(reveal|show|output|print|display|tell\s+me)\s+(your\s+)?(system\s+)?(prompt|instructions?)\b"),
    ("repeat_above", r"(?i)\brepeat\s+(the\s+)?(text|instructions?|prompt)\s*(above|starting\s+with)?\b")]


def words(c: Column) -> Column:
    """Lower-cased words: runs of letters and digits."""
    return F.filter(F.split(F.lower(c), WORD_GAP), lambda x: x != "")


def source_name(c: Column) -> Column:
    """Lower case, no outer blanks, inner blanks and hyphens as underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", ""), r"(?U)[\s\-]+", "_")


def tok_estimate(c: Column) -> Column:
    """At least 1, else a quarter of the code points."""
    return F.greatest(F.lit(1), F.floor(F.char_length(c) / 4)).cast("int")


def lang_detect(path: Column) -> Column:
    """Language by extension (source code by its exact case, documents by any), else by well-known bare names."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    ext = F.regexp_extract(base, r"[^.]\.([^.]+)$", 1)
    code = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])
    doc = F.create_map(*[F.lit(x) for p in TEXT_LANGUAGES.items() for x in p])
    bare = F.when((ext == "") & F.upper(base).isin(TEXT_NAMES), F.lit("text"))
    return F.coalesce(F.try_element_at(code, ext), F.try_element_at(doc, F.lower(ext)), bare)


def atx_heading(line: Column) -> Column:
    """Title of a heading of 1 to 6 marks at the line's start, blank or line end after them; null otherwise."""
    return F.when(line.rlike(r"^#{1,6}( |$)"), F.trim(F.regexp_replace(line, r"^#{1,6}", "")))


def strip_ansi(c: Column) -> Column:
    """Without terminal sequences and control characters, but for line ends and tabs."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\x1b\[[0-?]*[ -/]*[@-~]", ""), r"\x1b\][^\x07\x1b]*(\x07|\x1b\\)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\x1b.", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def normalize_path(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def html_unescape(c: Column) -> Column:
    """Six named entities, the ampersand first."""
    for entity, to in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(entity), F.lit(to))
    return c


def format_age(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds)
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(name))
    return F.when(s < 90, unit(1, " sec ago")).when(s < 3600, unit(60, " min ago")).when(s < 86400, unit(3600, " hr ago")).otherwise(unit(86400, " days ago"))


def parse_as_of(c: Column) -> Column:
    """Epoch seconds (UTC) of a date, a minute or a second, blank or T between, an optional Z; null otherwise."""
    t = F.regexp_replace(F.regexp_replace(c, "Z+$", ""), "T", " ")
    ok = t.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}(:\d{2})?)?$")
    return F.when(ok, F.try_to_timestamp(t).cast("long"))


def split_csv(c: Column) -> Column:
    """Trimmed values between commas, empties dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def csv_union(a: Column, b: Column) -> Column:
    """The first list's values in order, then the second's new ones; trimmed, no blanks, nulls or repeats."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def json_string(c: Column) -> Column:
    """A JSON string literal: backslash, quote and control characters escaped (lower-case hex), all else as it is."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for i in range(32):
        out = F.replace(out, F.lit(chr(i)), F.lit(short.get(i, f"\\u{i:04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def entity_id(kind: Column, title: Column, body: Column) -> Column:
    """SHA-256 of the compact JSON of body, kind and title in that order: the content address of a note."""
    return F.sha2(F.concat(F.lit('{"body":'), json_string(body), F.lit(',"kind":'), json_string(kind), F.lit(',"title":'), json_string(title), F.lit("}")), 256)


def embedding_text(name: Column, summary: Column, docstring: Column, content: Column) -> Column:
    return F.concat(
        F.lit("title: "), F.coalesce(name, F.lit("none")), F.lit(" | "), F.coalesce(F.concat(F.lit("summary: "), F.nullif(summary, F.lit("")), F.lit(" | ")), F.lit("")),
        F.lit("text: "), F.coalesce(F.concat(F.nullif(docstring, F.lit("")), F.lit("\n")), F.lit("")), content)


def has_secret(c: Column) -> Column:
    return F.coalesce(c.rlike("|".join(f"(?:{p})" for p in SECRET_PATTERNS)), F.lit(False))


def injection_category(title: Column, body: Column) -> Column:
    """field:category of the first pattern that matches, patterns in order, the title before the body; null if none."""
    tests = [F.when(c.rlike("(?U)" + p), F.lit(f"{field}:{cat}")) for cat, p in INJECTION_PATTERNS for field, c in (("title", title), ("body", body))]
    return F.coalesce(*tests)


def generated_marker(content: Column) -> Column:
    """The mark found in the first five lines of the first 4,096 characters, or null."""
    head = F.slice(F.split(F.substring(content, 1, 4096), "\n"), 1, 5)
    return F.coalesce(*[F.when(F.exists(head, test), F.lit(mark)) for mark, test in (
        ("@generated", lambda x: x.contains("@generated")), ("Code generated", lambda x: F.rtrim(x).rlike(r"^// Code generated by .* DO NOT EDIT\.$")))])


def is_binary(content: Column) -> Column:
    """A NUL among the first 512 characters."""
    return F.substring(content, 1, 512).contains("\u0000")


def is_file_query(symbol: Column) -> Column:
    return symbol.contains("/") | symbol.contains("\\") | symbol.rlike(r"\.(rs|py|go|java|ts|js)$")


def case_style(name: Column) -> Column:
    """Style of a name; names under three bytes and mixtures have none (null)."""
    upper, lower, under = name.rlike(r"\p{Lu}"), name.rlike(r"\p{Ll}"), name.contains("_")
    first = name.rlike(r"^\p{Lu}")
    return F.when(F.octet_length(name) < 3, None).when(upper & ~lower & under, "SCREAMING_SNAKE_CASE").when(first & ~under, "PascalCase").when(
        ~first & upper & ~under, "camelCase").when(lower & ~upper, "snake_case")


def truncate_bytes(c: Column, limit: int) -> Column:
    """The longest prefix of at most `limit` bytes that ends between characters."""
    raw = F.encode(c, "UTF-8")
    starts = lambda i: ~F.hex(F.substring(raw, i + 1, 1)).rlike("^[89AB]")
    cut = F.coalesce(*[F.when(starts(limit - k), F.lit(limit - k)) for k in range(4)], F.lit(limit))
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))
