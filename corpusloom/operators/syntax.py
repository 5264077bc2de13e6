"""Definitions and complexity of source files, by small scanners: Python's own parser, and brace matching for others.

A parser of one's own can be set with register_scanner(); counts of nodes and depth depend on the parser.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

# Languages whose syntax is known, by suffix.
SYNTAX = {".py": "python", ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".yaml": "yaml", ".yml": "yaml", ".tf": "hcl"}
# Weights of the complexity score.
WEIGHTS = {"max_depth": 0.4, "node_count": 0.01, "def_count": 0.5, "import_count": 0.2}

#: (kind, name or None, first line, last line, top-level?) of a text's definitions, in order.
Definition = tuple[str, str | None, int, int, bool]
_OPENERS = {
    "go": [(r"func\s+\([^)]*\)\s*(\w+)?", "method_declaration"), (r"func\s+(\w+)", "function_declaration"), (r"type\s()", "type_declaration")],
    "typescript": [
        (r"(?:async\s+)?function\s*\*?\s*(\w+)", "function_declaration"), (r"class\s+(\w+)", "class_declaration"), (r"interface\s+(\w+)", "interface_declaration"),
        (r"type\s+(\w+)\s*(?:<[^=]*>)?\s*=", "type_alias_declaration"), (r"enum\s+(\w+)", "enum_declaration"), (r"var\s()", "variable_declaration"),
    ],
    "hcl": [(r"([A-Za-z_]\w*)(?:\s+\"[^\"]*\"|\s+\w+)*\s*\{", "block")],
}
_METHOD = re.compile(r"\s+(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+)*\*?([#\w$]+)\s*(?:<[^>(]*>)?\([^;]*\)\s*(?::[^=;]+)?\{\s*(?:.*\})?\s*$")
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "super", "await"}
_ARROW = re.compile(r"(?:(?<==)|(?<=[(,?])|(?<=return)|(?<=>)|^)\s*(?:async\s+)?(?:\([^()]*\)(?:\s*:\s*[\w<>\[\]|. ]+)?|([A-Za-z_$][\w$]*))\s*=>")
_KEY = re.compile(r"(\s*(?:- +)*)(?:\"[^\"]*\"|'[^']*'|[^\s#'\"\[\]{},&*!|>%@`-][^#]*?|-[^\s#:][^#]*?)\s*:(?:\s|$)")
_IMPORTS = {"go": r"import\b", "typescript": r"import\b"}


def _python(text: str) -> list[Definition]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    top = {id(n) for n in tree.body if not getattr(n, "decorator_list", None)}
    kinds = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition"}
    return sorted(((kinds[type(n)], n.name, n.lineno, n.end_lineno, id(n) in top) for n in ast.walk(tree) if type(n) in kinds), key=lambda d: d[2])


def _closing(lines: list[str], i: int, start: int = 0, needs_brace: bool = False) -> int:
    """The line on which what opens on line i, from character start on, is closed again."""
    depth, seen = 0, False
    for j in range(i, len(lines)):
        part = lines[j][start:] if j == i else lines[j]
        depth += part.count("{") - part.count("}")
        seen = seen or "{" in part
        if depth <= 0 and (seen or not needs_brace or part.rstrip().endswith(";")):
            return j
    return len(lines) - 1


def _braces(text: str, language: str) -> list[Definition]:
    lines, found = text.split("\n"), []
    for i, line in enumerate(lines):
        for pattern, kind in _OPENERS[language]:
            if m := re.match(rf"\s*(?:{pattern})", line):
                # In HCL, blocks stand below a body node, so none is at the top.
                found.append((kind, m[1] or None, i + 1, _closing(lines, i, needs_brace="(" in line) + 1, not line[:1].isspace() and language != "hcl"))
                break
        else:
            if language == "typescript" and (m := _METHOD.match(line)) and m[1] not in _NOT_METHODS:
                found.append(("method_definition", None, i + 1, _closing(lines, i, needs_brace=True) + 1, False))
        if language == "typescript":
            # A function without parentheses is known by its parameter.
            found += [("arrow_function", m[1], i + 1, _closing(lines, i, m.start()) + 1, False) for m in _ARROW.finditer(line)]
    return found


def _mappings(text: str) -> list[Definition]:
    """The keys of YAML's block mappings, each with what is indented below it; none stands at the top of the syntax tree."""
    lines = text.split("\n")
    depth = [len(x) - len(x.lstrip(" ")) if x.strip() and not x.lstrip().startswith("#") else None for x in lines]
    found = []
    for i, line in enumerate(lines):
        if depth[i] is None or not (m := _KEY.match(line)):
            continue
        end = i
        for j in range(i + 1, len(lines)):
            if depth[j] is not None:
                # A list may stand as deep as its key.
                if depth[j] < m.end(1) or depth[j] == m.end(1) and not (lines[j].lstrip().startswith("- ") and m.end(1) == depth[i]):
                    break
                end = j
        found.append(("block_mapping_pair", None, i + 1, end + 1, False))
    return found


SCANNERS: dict[str, Callable[[str], list[Definition]]] = {"python": _python, "yaml": _mappings} | {x: (lambda t, x=x: _braces(t, x)) for x in _OPENERS}


def register_scanner(language: str, scan: Callable[[str], list[Definition]]) -> None:
    SCANNERS[language] = scan


def _suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1] if "." in name[1:] else ""


def definitions(path: str, text: str) -> list[Definition] | None:
    """None if the suffix has no known syntax."""
    language = SYNTAX.get(_suffix(path))
    return None if language is None else SCANNERS[language](text)


def symbols_of(path, text):
    """Column of the named definitions at any depth."""

    @F.pandas_udf("array<struct<name:string,kind:string,start_line:int,end_line:int>>")
    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"name": n, "kind": k, "start_line": a, "end_line": b} for k, n, a, b, _ in definitions(p, t) or [] if n] for p, t in zip(paths, texts, strict=True)])

    return run(path, text)


def _sanitize(text: str) -> str:
    # Patterns and placeholders, as functions.text.sanitize() has them.
    return re.sub("\"[^\"]{500,}\"|'[^']{500,}'", "[LONG_STRING_STRIPPED]", re.sub(r"[A-Za-z0-9+/]{100,}=*", "[BASE64_DATA_STRIPPED]", text))


def definition_chunks(size: int, overlap: int):
    """A UDF from (filepath, content) to chunks: one for each top-level definition and for each stretch between, in windows if longer than size."""

    def windows(text: str, first: int, kind: str | None, names: list[str]) -> list[dict]:
        lines = text.splitlines()
        if len(lines) <= size:
            return [{"content": text, "line_start": first, "line_end": first + len(lines) - 1, "type": kind, "symbols": names}]
        return [
            {"content": "\n".join(lines[a : a + size]), "line_start": first + a, "line_end": first + min(a + size, len(lines)) - 1, "type": kind, "symbols": names}
            for a in range(0, len(lines), size - overlap)
        ]

    def one(path: str, text: str) -> list[dict]:
        found = definitions(path, text)
        if found is None:
            parts = windows(text, 1, None, [])
        else:
            lines, parts, at = text.splitlines(), [], 1

            def between(first: int, last: int) -> None:
                while first <= last and not lines[first - 1].strip():
                    first += 1
                while last >= first and not lines[last - 1].strip():
                    last -= 1
                if first <= last:
                    parts.extend(windows("\n".join(lines[first - 1 : last]), first, "general", []))

            for kind, name, start, end, top in found:
                if top and start >= at:
                    between(at, start - 1)
                    parts.extend(windows(_sanitize("\n".join(lines[start - 1 : end])), start, kind, [name] if name else []))
                    at = end + 1
            between(at, len(lines))
        return parts

    @F.pandas_udf("array<struct<content:string,line_start:int,line_end:int,type:string,symbols:array<string>>>")
    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([one(p, t) for p, t in zip(paths, texts, strict=True)])

    return run


def _depth_and_nodes(path: str, text: str) -> tuple[int, int, int]:
    """Depth, nodes and imports."""
    if SYNTAX[_suffix(path)] == "python":
        try:
            level, depth, nodes, imports = [ast.parse(text)], 0, 0, 0
        except (SyntaxError, ValueError, RecursionError):
            return 0, 1, 0
        while level:
            nodes += len(level)
            imports += sum(isinstance(n, (ast.Import, ast.ImportFrom)) for n in level)
            level = [c for n in level for c in ast.iter_child_nodes(n)]
            depth += bool(level)
        return depth, nodes, imports
    pattern = _IMPORTS.get(SYNTAX[_suffix(path)])
    depth = most = 0
    words = re.findall(r"[\w]+|[^\w\s]", text)
    for w in words:
        depth += (w in "{[(") - (w in "}])")
        most = max(most, depth)
    indent = max((len(x) - len(x.lstrip(" ")) for x in text.split("\n")), default=0) // 2
    return max(most, indent) + bool(words), 1 + len(words), len(re.findall(rf"(?m)^{pattern}", text)) if pattern else 0


COUNTS = "max_depth int, node_count int, line_count int, def_count int, import_count int, language string, error string"


def syntax_counts(paths: pd.Series, texts: pd.Series) -> pd.DataFrame:
    rows = []
    for path, text in zip(paths, texts, strict=True):
        found = definitions(path, text or "")
        if found is None:
            rows.append((None, None, None, None, None, None, f"Unsupported extension {_suffix(path)}"))
        else:
            depth, nodes, imports = _depth_and_nodes(path, text or "")
            rows.append((depth, nodes, len((text or "").splitlines()), len(found), imports, SYNTAX[_suffix(path)], None))
    out = pd.DataFrame(rows, columns=["max_depth", "node_count", "line_count", "def_count", "import_count", "language", "error"])
    return out.astype({c: "Int32" for c in out.columns[:5]})


def complexity_score():
    """The weighted sum of max_depth, node_count, def_count and import_count, to two places."""
    return F.round(sum((F.col(c) * F.lit(w) for c, w in WEIGHTS.items()), F.lit(0.0)), 2)


def complexity(files):
    """filepath and complexity of each file (filepath, content), with `triage` for scores over 50; unsupported suffixes carry an error."""
    rows = files.select("filepath", F.pandas_udf(syntax_counts, COUNTS)("filepath", "content").alias("c")).select("filepath", "c.*")
    return rows.withColumn("complexity_score", complexity_score()).withColumn("triage", F.when(F.col("complexity_score") > 50, "Escalate to Flagship"))
