"""Code structure by language: classes, functions, imports, variables and a complexity, in one struct for all languages."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrow import arrow
from ..functions.text import let, line_counts
from ..schema import STRUCTURE

_FIELDS = ("name", "line", "type")
_BRANCHES = tuple(getattr(ast, n) for n in "AsyncFor AsyncWith ExceptHandler For If While With".split())
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _name(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id if isinstance(node, ast.Name) else type(node).__name__, *reversed(parts)])


def python_structure(text: str, with_async: bool = True) -> dict | None:
    """By Python's own parser, in breadth-first order; None if it can't parse the text. with_async: async functions too."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    kinds = _FUNCTIONS if with_async else (ast.FunctionDef,)
    out: dict = {"classes": [], "functions": [], "imports": [], "variables": [], "complexity": 0}
    for node in ast.walk(tree):
        if isinstance(node, _BRANCHES):
            out["complexity"] += 1
        elif isinstance(node, ast.BoolOp):
            out["complexity"] += len(node.values) - 1
        if isinstance(node, ast.ClassDef):
            methods = [x.name for x in node.body if isinstance(x, kinds)]
            out["classes"].append({"docstring": ast.get_docstring(node), "name": node.name, "line": node.lineno, "type": "class", "bases": [_name(b) for b in node.bases], "methods": methods})
        elif isinstance(node, kinds):
            out["functions"].append({"name": node.name, "line": node.lineno, "args": [a.arg for a in node.args.args], "returns": node.returns and _name(node.returns), "docstring": ast.get_docstring(node), "is_async": isinstance(node, ast.AsyncFunctionDef), "type": "function"})
        elif isinstance(node, ast.Import):
            out["imports"] += [{"module": a.name, "alias": a.asname, "type": "import"} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["imports"] += [{"module": node.module or "", "name": a.name, "alias": a.asname, "type": "from_import"} for a in node.names]
        elif isinstance(node, ast.Assign):
            out["variables"] += [{"name": t.id, "line": node.lineno, "type": "assignment"} for t in node.targets if isinstance(t, ast.Name)]
    return out


_ACCESS = r"(?:private|protected|public)?"
_STATIC, _FINAL = r"(?:static\s+)?", r"(?:final\s+)?"
_ARGUMENTS, _TYPES = r"\s*\([^)]*\)\s*", r"(?:\w+\s+)*"
_QUOTED = "['\"]([^'\"]+)['\"]"
#: language -> field -> (pattern, what to call the group, type)
PATTERNS: dict[str, dict[str, tuple[str, str, str]]] = {
    "javascript": {
        "functions": (r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>))", "name", "function"),
        "classes": (r"class\s+(\w+)", "name", "class"),
        "imports": (rf"(?:import\s+(?:\{{[^}}]*\}}|\w+|\*\s+as\s+\w+)\s+from\s+{_QUOTED}|require\s*\(\s*{_QUOTED}\s*\))", "module", "import"),
    },
    "java": {
        "classes": (rf"{_ACCESS}\s*{_STATIC}{_FINAL}class\s+(\w+)", "name", "class"),
        "methods": (rf"{_ACCESS}\s*{_STATIC}{_FINAL}{_TYPES}(\w+){_ARGUMENTS}(?:throws\s+[\s\w,]+)?\s*\{{", "name", "method"),
        "imports": (r"import\s+([.\w]+);", "module", "import"),
    },
    "cpp": {
        "classes": (r"class\s+(\w+)(?:\s*:\s*[\s\w,]+)?\s*\{", "name", "class"),
        "functions": (rf"{_TYPES}(\w+){_ARGUMENTS}(?:const\s*)?\s*\{{", "name", "function"),
        "includes": (r'#include\s*[<"]([^">]+)[>"]', "header", "include"),
    },
}
PATTERNS["typescript"], PATTERNS["c"] = PATTERNS["javascript"], PATTERNS["cpp"]
_COMPILED = {k: {f: (re.compile(p), name, kind) for f, (p, name, kind) in own.items()} for k, own in PATTERNS.items()}
_BRANCH_SIGNS = [re.compile(p) for p in (r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bswitch\s*\(", r"\bcatch\s*\(", r"\?\s*.*\s*:", "&&", r"\|\|")]


def pattern_complexity(text: str) -> int:
    return sum(len(p.findall(text)) for p in _BRANCH_SIGNS)


_TAIL = re.compile(r"\([^)]*\)\s*(?:throws\s+[\s\w,]+|const\s*)?\s*\{")


def _bodies(p: re.Pattern, text: str):
    """The matches of a pattern for functions with a body. They can only begin where the run of words before an opening
    bracket does, and only brackets with a body are looked at; tried from every word, the pattern would take quadratic time."""
    at = 0
    while tail := _TAIL.search(text, at):
        start = tail.start()
        while start > at and (text[start - 1].isspace() or text[start - 1] == "_" or text[start - 1].isalnum()):
            start -= 1
        found = p.search(text, start, tail.end())
        if found and found.end() == tail.end():
            yield found
            at = tail.end()
        else:
            at = tail.start() + 1


def pattern_structure(text: str, language: str) -> dict:
    out: dict = {"complexity": pattern_complexity(text)}
    breaks = [m.start() for m in re.finditer("\n", text)]
    for field, (p, name, kind) in _COMPILED[language].items():
        out[field] = [{name: next(g for g in m.groups() if g), "line": bisect_left(breaks, m.start()) + 1, "type": kind} for m in (_bodies(p, text) if field in ("methods", "functions") and language in ("java", "c", "cpp") else p.finditer(text))]
    if language in ("javascript", "typescript"):
        out["variables"] = []
    return out


def _arrow(items: dict[str, pa.DataType]) -> pa.DataType:
    return pa.list_(pa.struct(list(items.items())))


_S, _I, _L = pa.string(), pa.int32(), pa.list_(pa.string())
_TYPE = pa.struct([
    ("classes", _arrow({"name": _S, "line": _I, "type": _S, "bases": _L, "methods": _L, "docstring": _S})),
    ("functions", _arrow({"name": _S, "line": _I, "type": _S, "args": _L, "returns": _S, "docstring": _S, "is_async": pa.bool_()})),
    ("methods", _arrow({k: _I if k == "line" else _S for k in _FIELDS})),
    ("imports", _arrow({"module": _S, "name": _S, "alias": _S, "line": _I, "type": _S})),
    ("includes", _arrow({"header": _S, "line": _I, "type": _S})),
    ("variables", _arrow({k: _I if k == "line" else _S for k in _FIELDS})),
    ("total_lines", _I), ("non_empty_lines", _I), ("language", _S), ("complexity", _I),
])


@arrow(STRUCTURE)
def _parsed(texts: pa.Array, languages: pa.Array) -> pa.Array:
    rows = []
    for t, x in zip(texts.to_pylist(), languages.to_pylist()):
        found = None if t is None else python_structure(t) if x == "python" else pattern_structure(t, x) if x in _COMPILED else None
        rows.append(found if found is None else found | {"language": x})
    return pa.array(rows, _TYPE)


def code_structure(t: Column, language: Column) -> Column:
    """The struct STRUCTURE; null for Python texts that don't parse. Of texts in other languages only the lines are counted."""
    parsed = language.isin("python", *PATTERNS)
    return F.when(parsed, _parsed(F.when(parsed, t), language)).when(t.isNotNull(), let(line_counts(F.when(~F.coalesce(parsed, F.lit(False)), t)), lambda n: _generic(n, language)))


def _generic(n: Column, language: Column) -> Column:
    empty = F.lit(None).cast(STRUCTURE)
    counts = {"total_lines": n["all"], "non_empty_lines": n["full"], "language": language, "complexity": n["full"]}
    names = [_TYPE.field(i).name for i in range(_TYPE.num_fields)]
    return F.struct(*[counts[n].alias(n) if n in counts else empty[n].alias(n) for n in names])


def complexity(t: Column, language: Column) -> Column:
    return code_structure(t, language)["complexity"]
