"""Definitions and edges of source files in twenty languages, from the lexical structure of the text.

A file is read once: comments and the insides of strings are blanked (nested block comments where the language has them),
definitions are found by a pattern of their language and end where their braces, their indentation, their `end` or their
statement ends. Chunks follow from the definitions: each is one, with its name, the class around it and the comment right before
it; what is over the token cap is given up for its members if it is a container and cut into line windows if not; a file
without definitions is cut into line windows. Edges are imports, base types, implemented interfaces and calls with the
name of the definition around them, each (scope, target, kind) once, with the line it first stands on.

Null texts and unknown languages have no edges and line windows only; a text of any form is read without an error.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnset.operators.chunking import CAP_TOKENS, line_windows

# Calls of these names make no edges, by language.
BUILTINS = {
    "rust": ["Ok", "Err", "Some", "None", "Box", "Vec", "String", "Default", "From", "Into", "Clone", "Drop"],
    "python": ["print", "len", "range", "enumerate", "zip", "map", "filter", "sorted", "reversed", "list", "dict", "set", "tuple", "str", "int", "float", "bool", "type",
               "isinstance", "hasattr", "getattr", "setattr", "super", "open", "input", "repr", "abs", "max", "min", "sum", "any", "all", "iter", "next", "id", "hash"],
    "javascript": ["require", "import", "console", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "Promise", "Array", "Object", "String", "Number",
                   "Boolean", "Error", "Map", "Set", "JSON", "Math", "Date", "Symbol", "parseInt", "parseFloat", "isNaN", "fetch"],
    "go": ["make", "new", "len", "cap", "append", "copy", "delete", "close", "panic", "recover", "print", "println"],
    "php": ["isset", "unset", "empty", "count", "echo", "print", "printf", "sprintf", "var_dump", "die", "exit", "array", "in_array", "array_map", "array_filter",
            "array_merge", "implode", "explode", "strlen", "str_replace", "trim", "is_array", "is_null", "is_string", "gettype", "intval", "strval"],
    "ruby": ["puts", "print", "p", "pp", "raise", "require", "require_relative", "loop", "lambda", "proc", "attr_accessor", "attr_reader", "attr_writer", "new",
             "freeze", "dup", "clone", "send", "format", "sprintf", "Integer", "String", "Array", "Hash"],
    "csharp": ["WriteLine", "Write", "ToString", "Equals", "GetHashCode", "GetType", "Parse", "TryParse", "Format", "Add", "Remove", "Contains", "Count", "Select",
               "Where", "First", "FirstOrDefault", "Any", "All", "ToList", "ToArray", "nameof", "typeof"],
    "kotlin": ["println", "print", "listOf", "mutableListOf", "mapOf", "mutableMapOf", "setOf", "arrayOf", "emptyList", "emptyMap", "let", "run", "apply", "also",
               "with", "require", "requireNotNull", "check", "error", "TODO", "lazy", "map", "filter", "forEach", "toString"],
    "swift": ["print", "debugPrint", "assert", "assertionFailure", "precondition", "fatalError", "map", "filter", "reduce", "forEach", "compactMap", "flatMap",
              "sorted", "append", "insert", "remove", "contains", "count", "min", "max", "abs", "String", "Int", "Array"],
    "c": ["printf", "fprintf", "sprintf", "snprintf", "scanf", "fscanf", "malloc", "calloc", "realloc", "free", "memcpy", "memmove", "memset", "memcmp", "strlen",
          "strcpy", "strncpy", "strcmp", "strncmp", "fopen", "fclose", "fread", "fwrite", "fgets", "fputs", "assert", "exit", "abort"],
}
_SAME = {"jsx": "javascript", "typescript": "javascript", "tsx": "javascript", "cpp": "c"}

#: Words before a parenthesis that are no calls in any of the languages.
NOT_CALLED = ["if", "for", "while", "match", "switch", "catch", "return", "sizeof", "function", "fn", "func", "fun", "def", "elif", "except", "in", "and", "or", "not", "with", "assert",
              "lambda", "new", "await", "yield", "foreach", "using", "lock", "when", "else", "do", "try", "throw", "unless", "until", "guard", "let", "var", "where", "init", "constructor", "super", "this", "self"]


#: Words after which a name and a parenthesis are a call; after any other word they declare something.
BEFORE_CALLS = {"return", "await", "throw", "else", "yield", "in", "not", "and", "or", "case", "do", "go", "defer", "if", "while", "assert", "when", "is", "try", "unless", "until",
                "then", "raise", "echo", "print", "match", "move", "with", "delete", "typeof", "default", "from", "mut", "ref", "as"}


def builtins_of(language: str) -> list[str]:
    return BUILTINS.get(_SAME.get(language, language), [])


# --- comments and strings --------------------------------------------------------------------------------------------

_SLASH, _HASH, _DASH = r"//[^\n]*", r"#[^\n]*", r"--[^\n]*"
_DQ, _SQ, _TICK = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'", r"`(?:[^`\\]|\\.)*`"
_TRIPLE = r'"""(?s:.*?)"""|\'\'\'(?s:.*?)\'\'\''
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'"
_LEXIS = {  # line comments, block comment or not, strings
    "rust": (_SLASH, "/*", rf'r#"(?s:.*?)"#|"(?s:[^"\\]|\\.)*"|{_CHAR}'), "python": (_HASH, None, rf"{_TRIPLE}|{_DQ}|{_SQ}"),
    "go": (_SLASH, "/*", rf"{_DQ}|`[^`]*`|{_CHAR}"), "ruby": (_HASH, None, rf"{_DQ}|{_SQ}"), "php": (rf"{_SLASH}|{_HASH}", "/*", rf"{_DQ}|{_SQ}"),
    "hcl": (rf"{_SLASH}|{_HASH}", "/*", _DQ), "sql": (_DASH, "/*", _SQ), "css": (r"(?!)", "/*", rf"{_DQ}|{_SQ}"), "html": (r"(?!)", "<!--", r"(?!)")}
_DEFAULT = (_SLASH, "/*", rf"{_TRIPLE}|{_DQ}|{_SQ}|{_TICK}")
_NESTED = {"rust", "swift", "kotlin"}


@functools.cache
def _lexer(language: str) -> re.Pattern:
    line, block, strings = _LEXIS.get(language, _DEFAULT)
    return re.compile(f"(?P<comment>{line}{'|' + re.escape(block) if block else ''})|(?P<string>{strings})")


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def masked(text: str, language: str) -> tuple[str, str, list[tuple[int, int]]]:
    """The text with comments blanked, with comments and strings blanked (same length), and where the comments stand."""
    bare, code, comments, at = [], [], [], 0
    close = "-->" if language == "html" else "*/"
    for m in iter(lambda: _lexer(language).search(text, at), None):
        a, b = m.span()
        if m.lastgroup == "comment" and m.group() in ("/*", "<!--"):
            b = text.find(close, b) + len(close)
            if b < len(close):
                b = len(text)
            if language in _NESTED:
                depth, b = 1, a + 2
                for x in re.finditer(r"/\*|\*/", text[b:]):
                    depth += 1 if x.group() == "/*" else -1
                    if not depth:
                        break
                b = a + 2 + x.end() if not depth else len(text)
        if b <= a:
            break
        piece = text[a:b]
        if m.lastgroup == "comment":
            comments.append((a, b))
            bare += [text[at:a], _blank(piece)]
            code += [text[at:a], _blank(piece)]
        else:
            bare += [text[at:a], piece]
            code += [text[at:a], piece[0] + _blank(piece[1:-1]) + piece[-1] if len(piece) > 1 else piece]
        at = b
    return "".join(bare) + text[at:], "".join(code) + text[at:], comments


# --- definitions -----------------------------------------------------------------------------------------------------

_MODS = r"(?:(?:public|private|protected|internal|fileprivate|open|abstract|final|static|sealed|partial|override|virtual|async|export|default|declare|readonly|synchronized|native|inline|suspend|data|inner|companion|mutating|convenience|required|unsafe|extern|new)\s+)*"
_RUST = r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+(?:\"\s*\"\s+)?)*"
_C_FUNCTION = r"^(?!\s*(?:else|return|typedef|using|namespace|new|throw|goto|case)\b)[ \t]*[A-Za-z_][\w \t*&:<>,~\[\]]*?\b(?P<n>~?\w+)\s*\((?:[^;{}()]|\([^()]*\))*\)\s*(?:const\s*|noexcept\s*|override\s*|final\s*)*(?::[^{};]*)?\{"
_METHOD = r"^[ \t]*" + _MODS + r"(?:[\w<>\[\],.? \t]+?[ \t]+)?(?P<n>[A-Za-z_]\w*)\s*(?:<[^>{}()]*>)?\((?:[^;{}()]|\([^()]*\))*\)[^;{}()=]*\{"
_JS_METHOD = r"^[ \t]*(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+|\*\s*)*(?P<n>[A-Za-z_$#][\w$]*)\s*(?:<[^>{}()]*>)?\((?:[^;{}()]|\([^()]*\))*\)[^;{}()=]*\{"
_TYPE = lambda word: r"^[ \t]*" + _MODS + word + r"\s+(?P<n>[A-Za-z_]\w*)"
_JS = [("Function", "", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)"), ("Class", "class_declaration", _TYPE("class")), ("Method", "", _JS_METHOD)]
_TS = [*_JS, ("Interface", "", _TYPE("interface")), ("TypeAlias", "", r"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<n>\w+)[^=\n]*=")]
#: By language: (kind, label in the scope of members, pattern); a method counts inside a type only.
DEFINITIONS: dict[str, list[tuple[str, str, str]]] = {
    "rust": [("Function", "", _RUST + r"fn\s+(?P<n>\w+)"), ("Impl", "", r"^[ \t]*(?:unsafe\s+)?impl\b(?=[^;{]*\{)"), *[(k, "", _RUST + rf"{w}\s+(?P<n>\w+)") for k, w in
             (("Struct", "struct"), ("Enum", "enum"), ("Trait", "trait"), ("Module", "mod"), ("Constant", r"(?<=const )(?!fn\b|unsafe\b|async\b)"), ("TypeAlias", "type")) if k != "Constant"],
             ("Constant", "", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?const\s+(?P<n>\w+)\s*:")],
    "python": [("Function", "", r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>\w+)"), ("Class", "class_definition", r"^[ \t]*class[ \t]+(?P<n>\w+)")],
    "javascript": _JS, "jsx": _JS, "typescript": _TS, "tsx": _TS,
    "go": [("Function", "", r"^func\s+(?P<n>\w+)"), ("Function:Method", "", r"^func\s*\([^)]*\)\s*(?P<n>\w+)"), ("Struct", "", r"^(?:type\s+|[ \t]+)(?P<n>\w+)\s+(?:struct|interface)\b"), ("Struct", "", r"^type\s+(?P<n>\w+)\s+(?!struct\b|interface\b)[\w.\[\]*(]+")],
    "java": [("Class", "class_declaration", _TYPE("class")), ("Interface", "", _TYPE("interface")), ("Enum", "", _TYPE("enum")), ("Method", "", _METHOD)],
    "c": [("Function", "", _C_FUNCTION), ("Struct", "", r"\bstruct\s+(?P<n>\w+)\s*\{"), ("Enum", "", r"\benum\s+(?P<n>\w+)\s*\{")],
    "cpp": [("Function", "", _C_FUNCTION), ("Class", "class_specifier", r"\bclass\s+(?P<n>\w+)[^;{()]*\{"), ("Struct", "", r"\bstruct\s+(?P<n>\w+)[^;{()]*\{")],
    "php": [("Function", "", r"^[ \t]*" + _MODS + r"function\s+&?(?P<n>\w+)"), ("Class", "class_declaration", _TYPE("class")), ("Interface", "", _TYPE("interface")), ("Trait", "", _TYPE("trait")), ("Enum", "", _TYPE("enum"))],
    "ruby": [("Function:Method", "", r"^[ \t]*(?:\w+[ \t]+)?def[ \t]+(?:self\.)?(?P<n>[\w?!=]+)"), ("Class", "class", r"^[ \t]*class[ \t]+(?P<n>[\w:]+)"), ("Module", "", r"^[ \t]*module[ \t]+(?P<n>[\w:]+)")],
    "csharp": [("Class", "class_declaration", _TYPE("class")), ("Struct", "", _TYPE("(?:struct|record)")), ("Interface", "", _TYPE("interface")), ("Enum", "", _TYPE("enum")), ("Method", "", _METHOD)],
    "kotlin": [("Class", "class_declaration", r"^[ \t]*" + _MODS + r"(?:enum\s+class|annotation\s+class|class|interface)\s+(?P<n>\w+)"), ("Class", "object_declaration", r"^[ \t]*" + _MODS + r"object\s+(?P<n>\w+)"), ("Function", "", r"^[ \t]*" + _MODS + r"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<n>\w+)")],
    "swift": [("Class", "class_declaration", _TYPE("(?:class|struct|enum|extension|actor)")), ("Interface", "", _TYPE("protocol")), ("Function", "", r"^[ \t]*" + _MODS + r"func\s+(?P<n>\w+)"), ("Function:Method", "", r"^[ \t]*" + _MODS + r"(?P<n>init)[?!]?\s*\(")],
    "hcl": [("Module", "", r"^(?P<n>\w+(?:[ \t]+\"[^\"\n]*\")*)[ \t]*\{")],
    "proto": [("Struct", "", r"^[ \t]*message\s+(?P<n>\w+)"), ("Enum", "", r"^[ \t]*enum\s+(?P<n>\w+)"), ("Interface", "", r"^[ \t]*service\s+(?P<n>\w+)"), ("Function:Method", "", r"^[ \t]*rpc\s+(?P<n>\w+)")],
    "sql": [(k, "", rf"(?i)^[ \t]*create\s+(?:or\s+replace\s+)?(?:unique\s+|temp(?:orary)?\s+|materialized\s+)*{w}\s+(?:if\s+not\s+exists\s+)?(?P<n>[\w.\"]+)") for k, w in (("Struct", "table"), ("TypeAlias", "view"), ("Function", "function"), ("Constant", "index"))],
    "css": [("Rule", "", r"^[ \t]*(?P<n>[^\s@{}/;][^@{};]*?)\s*\{"), ("Module", "", r"^[ \t]*(?P<n>@(?:media|supports))\b"), ("Function", "", r"^[ \t]*(?P<n>@keyframes)\b")],
    "html": [("Function", "", r"(?i)<script\b(?P<n>[^>]*)>"), ("Module", "", r"(?i)<style\b(?P<n>[^>]*)>")],
}
_CONTAINERS = {"Module", "Impl", "Class", "Trait", "Interface"}


@functools.cache
def _patterns(language: str) -> list[tuple[str, str, re.Pattern]]:
    by_line = language in ("python", "ruby", "hcl", "sql", "go")
    start = r"^[ \t]*" if by_line else r"(?:^|(?<=[{};]))[ \t]*"
    return [(kind, label, re.compile(p.replace(r"^[ \t]*", start), re.M)) for kind, label, p in DEFINITIONS.get(language, [])]


def _braces(code: str) -> dict[int, int]:
    pairs, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs | dict.fromkeys(stack, len(code) - 1)


def _indented_end(code: str, start: int) -> int:
    """End of the last line that is indented deeper than the line of the definition (a head over several lines included)."""
    first = code.rfind("\n", 0, start) + 1
    indent = re.match(r"[ \t]*", code[first:]).end()
    head, depth = re.compile(r"[()\[\]:]"), 0
    body = len(code)
    for m in head.finditer(code, start):
        depth += m.group() in "([" or -(m.group() in ")]")
        if m.group() == ":" and depth <= 0:
            body = m.end()
            break
    end = code.find("\n", body)
    end = len(code) if end < 0 else end
    for m in re.compile(r"^([ \t]*)\S[^\n]*", re.M).finditer(code, end):
        if len(m.group(1)) <= indent:
            break
        end = m.end()
    return end


_RUBY_STEP = re.compile(r"^[ \t]*(?:\w+[ \t]+)?(?:def|class|module)\b|^[ \t]*(?:if|unless|while|until|case|begin|for)\b|=[ \t]*(?:if|unless|case|begin)\b|\bdo\b(?:[ \t]*\|[^|\n]*\|)?[ \t]*$|\bend\b", re.M)


def definitions(text: str, language: str, code: str | None = None, bare: str | None = None) -> list[tuple[str, str, str | None, int, int]]:
    """(kind, label, name, start, end) of every definition, outer ones first."""
    if code is None or bare is None:
        bare, code, _ = masked(text, language)
    found, pairs = {}, None
    opens: list[int] = []
    for kind, label, pattern in _patterns(language):
        for m in pattern.finditer(bare if language in ("hcl", "html") else code):
            start = m.start() + len(re.match(r"\s*", m.group()).group())
            name = m.groupdict().get("n")
            if name in NOT_CALLED and kind in ("Method", "Function") and name not in ("init", "constructor"):
                continue
            if language == "python":
                end = _indented_end(code, start)
            elif language == "ruby":
                depth, end = 0, len(code)
                for x in _RUBY_STEP.finditer(code, code.rfind("\n", 0, start) + 1):
                    depth += -1 if x.group() == "end" else 1
                    if not depth:
                        end = x.end()
                        break
            elif language == "sql":
                end = code.find(";", m.end()) + 1 or len(code)
            elif language == "html":
                tag = re.match(r"<(\w+)", m.group()).group(1)
                x = re.compile(rf"(?i)</{tag}\s*>").search(bare, m.end())
                attr = re.search(r"(?i)\b(?:src|id)\s*=\s*[\"']?([^\"'\s>]+)", name)
                name, end = attr.group(1) if attr else tag, x.end() if x else len(code)
            else:
                if pairs is None:
                    pairs = _braces(code)
                    opens = sorted(pairs)
                i = bisect_right(opens, max(start, m.end() - 1) - 1)
                stop = code.find(";", m.end() - 1)
                if language in ("go", "kotlin", "typescript", "tsx") and not m.group().rstrip().endswith("{"):
                    line = code.find("\n", m.end())
                    stop = min(x for x in (stop, line, len(code)) if x >= 0) if kind in ("TypeAlias", "Struct") or language == "kotlin" and (i >= len(opens) or "\n" in code[m.end():opens[i]].strip()) else stop
                if i < len(opens) and (stop < 0 or opens[i] < stop):
                    end = pairs[opens[i]] + 1
                elif language == "rust" and kind == "Function":  # a signature defines nothing
                    continue
                else:
                    end = stop + 1 if 0 <= stop < len(code) else len(code)
            if language == "hcl":
                name = ".".join(re.findall(r"[^\s\"]+", name))
            found.setdefault(start, (kind, label, name, start, max(end, m.end() - 1)))
    ordered, out, stack = sorted(found.values(), key=lambda d: (d[3], -d[4])), [], []
    for kind, label, name, start, end in ordered:
        while stack and stack[-1][4] <= start:
            stack.pop()
        inside = bool(stack) and stack[-1][0] in ("Class", "Struct", "Interface", "Enum", "Trait", "Impl")
        if kind == "Method" and not inside:
            continue
        if kind == "Function" and inside and language == "php":
            kind = "Method"
        d = (kind.rpartition(":")[2], label, name, start, end)
        out.append(d)
        stack.append(d)
    return out


def _doc_before(text: str, comments: list[tuple[int, int]], start: int) -> str | None:
    """The comments that end right before a definition, attributes and decorators between them skipped; lines of comments run together."""
    at, parts = start, []
    for a, b in reversed(comments[:bisect_right(comments, (start, start))]):
        between = text[b:at]
        if re.sub(r"(?m)^[ \t]*(?:#!?\[[^\n]*\]|@[^\n]*|(?:pub|export|private|public|protected|static|async|abstract)\b[ \t]*)?$", "", between).strip() or parts and "\n\n" in between.replace(" ", ""):
            break
        if text[text.rfind("\n", 0, a) + 1:a].strip():  # a comment after code belongs to that code
            break
        parts.append(text[a:b])
        at = a
    return "\n".join(reversed(parts)) or None


def chunk_source(text: str, language: str, cap_tokens: int = CAP_TOKENS) -> list[tuple]:
    """(kind, name, parent_scope, start_line, end_line, content, docstring) of each chunk of a file."""
    bare, code, comments = masked(text, language)
    defs = definitions(text, language, code, bare)
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]
    line = lambda at: bisect_right(starts, at)
    big = lambda s: max(1, len(s) // 4) > cap_tokens
    out, stack = [], []
    for i, (kind, label, name, start, end) in enumerate(defs):
        while stack and stack[-1][0] <= start:
            stack.pop()
        scope = stack[-1][1] if stack else None
        inner = f"{label} {name}" if kind == "Class" and name else None if kind == "Impl" else scope
        stack.append((end, inner))
        content, doc = text[start:end], _doc_before(text, comments, start)
        if not big(content):
            out.append((kind, name, scope, line(start), line(max(start, end - 1)), content, doc))
        elif kind not in _CONTAINERS or i + 1 == len(defs) or defs[i + 1][3] >= end:
            out += [("Verbatim", name, scope, line(start) + a - 1, line(start) + b - 1, c, doc) for a, b, c in line_windows(content, cap_tokens)]
    return out or [("Verbatim", None, None, a, b, c, None) for a, b, c in line_windows(text, cap_tokens)]


# --- edges -----------------------------------------------------------------------------------------------------------

#: By language and kind: patterns whose first group is a target or a list of targets.
EDGES: dict[str, list[tuple[str, str]]] = {
    "rust": [("imports", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([^;]+);")],
    "python": [("imports", r"(?m)^[ \t]*import[ \t]+([\w., \t]+)"), ("imports", r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b")],
    "javascript": [("imports", r"(?m)^[ \t]*import\b(?:[^'\";]*?\bfrom)?[ \t]*[\"']([^\"'\n]+)[\"']")],
    "go": [("imports", r"(?m)^[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?\"([^\"\n]+)\""), ("imports", r"(?m)^[ \t]+(?:[\w.]+[ \t]+)?\"([\w./-]+)\"[ \t]*$")],
    "java": [("imports", r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)"), ("extends", r"\bclass[ \t]+\w+(?:<[^>{]*>)?\s+extends\s+([\w.<>]+)"), ("implements", r"\bclass[ \t]+\w+[^{;]*?\bimplements\s+([\w., \t\n<>]+)")],
    "c": [("imports", r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]")],
    "php": [("imports", r"(?m)^[ \t]*use[ \t]+([^;{(]+);"), ("imports", r"\b(?:require|include)(?:_once)?[ \t]*\(?[ \t]*[\"']([^\"'\n]+)[\"']"),
            ("extends", r"\bclass[ \t]+\w+\s+extends\s+(\w+)"), ("implements", r"\bclass[ \t]+\w+[^{;]*?\bimplements\s+([\w, \t\n]+)")],
    "ruby": [("imports", r"(?m)^[ \t]*(?:require|require_relative|load|autoload)\b[ \t(]*(?::\w+[ \t]*,[ \t]*)?[\"']([^\"'\n]+)[\"']"), ("extends", r"(?m)^[ \t]*class[ \t]+[\w:]+[ \t]*<[ \t]*([A-Z]\w*)"),
             ("implements", r"(?m)^[ \t]*(?:include|extend|prepend)[ \t(]+([A-Z][\w, \t]*)")],
    "csharp": [("imports", r"(?m)^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;"), ("extends", r"\b(?:class|struct|record|interface)[ \t]+\w+(?:<[^>{]*>)?(?:\([^)]*\))?\s*:\s*([\w.<>, \t\n]+?)\s*(?:\{|;|\bwhere\b)")],
    "kotlin": [("imports", r"(?m)^[ \t]*import[ \t]+([\w.]+)"), ("extends", r"\b(?:class|object|interface)[ \t]+\w+(?:<[^>{]*>)?(?:\s*\([^)]*\))?\s*:\s*([\w.<>(), \t\n]+?)\s*(?:\{|$)")],
    "swift": [("imports", r"(?m)^[ \t]*(?:@\w+[ \t]+)?import[ \t]+(?:(?:class|struct|enum|func|protocol|typealias|let|var)[ \t]+)?([\w.]+)"), ("extends", r"\b(?:class|struct|enum|extension|actor)[ \t]+\w+(?:<[^>{]*>)?\s*:\s*([\w., \t\n<>]+?)\s*(?:\{|\bwhere\b)")],
    "html": [("imports", r"(?i)\b(?:src|href)[ \t]*=[ \t]*[\"']([^\"'\n]*)[\"']")],
    "css": [("imports", r"(?m)^[ \t]*@import[ \t]+(?:url\([ \t]*)?[\"']?([^\"')\s;]+)")],
}
_CALL = re.compile(r"(?<![\w$.:])((?:[A-Za-z_$][\w$]*(?:::<[^>()]*>)?(?:::|\?\.|->|\.))*)([A-Za-z_$][\w$!?]*)(?:::<[^>()]*>)?\(|(?<=[)\]}])\s*(?:\?\.|->|\.)([A-Za-z_$][\w$]*)\(")


def edge_patterns(language: str) -> list[tuple[str, str]]:
    return EDGES.get(_SAME.get(language, language), [])


def _targets(kind: str, language: str, found: str) -> list[str]:
    if kind == "imports":
        if language == "python":
            return [x.split(" as ")[0].strip() for x in re.sub(r"\s+", " ", found).split(",") if x.strip()]
        return [re.sub(r"\s+", " ", found).strip()] if found.strip() and not (language == "html" and re.match(r"#|data:", found.strip())) else []
    flat, depth = [""], 0
    for c in found:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            flat.append("")
        else:
            flat[-1] += c
    names = [re.sub(r"\(.*", "", x, flags=re.S).strip() for x in flat]
    return [x if language in ("csharp", "java") else re.sub(r"<.*", "", x, flags=re.S) for x in names if x]


def _called(m: re.Match, language: str) -> list[str]:
    path, name = m.group(1) or "", m.group(2) or m.group(3)
    if language == "rust" and path.endswith("::"):
        whole = re.sub(r"::<[^>()]*>", "", path)
        return [whole + name, name, whole[:-2]]
    if language == "go" and path:
        return [path + name]
    if language in ("c", "cpp", "kotlin") and (path or not m.group(2)):
        return []
    return [name.rstrip("!?") if language != "ruby" else name]


def source_edges(text: str, language: str) -> list[tuple[str | None, str, str, int]]:
    """(scope, target, kind, line) of each edge, each (scope, target, kind) once."""
    if not edge_patterns(language) and language not in DEFINITIONS or language in ("hcl", "proto", "sql", "json"):
        return []
    bare, code, _ = masked(text, language)
    defs = definitions(text, language, code, bare) if language not in ("html", "css", "c", "cpp") else []
    scopes = [d for d in defs if d[2] and d[0] in ("Function", "Method", "Class", "Struct", "Interface", "Module")
              and not (language in ("javascript", "typescript", "jsx", "tsx") and d[0] in ("Method", "Interface")) and not (language in ("rust", "go") and d[0] not in ("Function", "Method"))]
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]
    found = []
    for kind, pattern in edge_patterns(language):
        for m in re.finditer(pattern, bare):
            if code[m.start():m.end()].strip():
                found += [(m.start(), m.start(1), t, kind) for t in _targets(kind, language, m.group(1))]
    if language not in ("html", "css"):
        heads = {code.find(d[2], d[3]) for d in defs if d[2]}
        skip = {*NOT_CALLED, *builtins_of(language)}
        for m in _CALL.finditer(code):
            at = m.start(2) if m.group(2) else m.start(3)
            before = re.search(r"(\w+)[ \t]+$", code[max(0, m.start() - 40):m.start()])
            declared = before and (before.group(1) not in BEFORE_CALLS if language != "ruby" else before.group(1) == "def")
            if at not in heads and not declared:
                found += [(at, at, t, "calls") for t in _called(m, language) if t not in skip]
    out, seen, i, stack = [], set(), 0, []
    for at, inside, target, kind in sorted(found, key=lambda x: (x[0], x[3] != "imports")):
        while i < len(scopes) and scopes[i][3] <= inside:
            stack.append(scopes[i])
            i += 1
        while stack and stack[-1][4] <= inside:
            stack.pop()
        scope = stack[-1][2] if stack else None
        if (scope, target, kind) not in seen:
            seen.add((scope, target, kind))
            out.append((scope, target, kind, bisect_right(starts, at)))
    return out


# --- over tables -----------------------------------------------------------------------------------------------------


def file_chunks(files: DataFrame, key: str = "file_id", text: str = "text", language: str = "language", cap_tokens: int = CAP_TOKENS) -> DataFrame:
    """files(key, language, text) to one row per chunk."""
    schema = f"{key} {files.schema[key].dataType.simpleString()}, kind string, name string, parent_scope string, start_line int, end_line int, content string, docstring string"

    def run(frames):
        for pdf in frames:
            rows = [(k, *c) for k, g, t in zip(pdf[key].tolist(), pdf[language].tolist(), pdf[text].tolist()) for c in chunk_source(t or "", g or "", cap_tokens)]
            yield pd.DataFrame(rows, columns=[key, "kind", "name", "parent_scope", "start_line", "end_line", "content", "docstring"])

    return files.select(key, language, text).mapInPandas(run, schema)


def file_edges(files: DataFrame, path: str = "path", text: str = "text", language: str = "language") -> DataFrame:
    """files(path, language, text) to source_file, source_name, target_name, kind, line."""

    def run(frames):
        for pdf in frames:
            rows = [(p, *e) for p, g, t in zip(pdf[path].tolist(), pdf[language].tolist(), pdf[text].tolist()) for e in source_edges(t or "", g or "")]
            yield pd.DataFrame(rows, columns=["source_file", "source_name", "target_name", "kind", "line"])

    return files.select(path, language, text).mapInPandas(run, "source_file string, source_name string, target_name string, kind string, line int")


def pattern_edges(files: DataFrame, kind: str, path: str = "path", text: str = "text", language: str = "language") -> DataFrame:
    """Targets of one kind other than calls by the patterns of the language alone, within the JVM: path, found (as written), without scopes."""
    none = F.array().cast("array<string>")
    found = none
    for g in sorted({*EDGES, *_SAME}):
        own = [p for k, p in edge_patterns(g) if k == kind]
        if own:
            every = F.array_union(*[F.regexp_extract_all(text, F.lit(p), 1) for p in own]) if len(own) == 2 else F.array_distinct(F.regexp_extract_all(text, F.lit(own[0]), 1))
            found = F.when(F.col(language) == g, every).otherwise(found)
    return files.select(path, F.explode(found).alias("found"))
