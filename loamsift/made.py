"""Records made up from the documents table, for queries on things that its prose doesn't hold: code, blank lines, addresses.

Each is a SQL expression over doc_id and text that Spark and DuckDB read alike, so both engines make the same records of
every document. No expression holds a backslash, which the two read differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import n_lines

_ID, _NL = "cast(doc_id AS string)", "chr(10)"


def _lines(*parts: str) -> str:
    """The lines one after another; {id} is the document's number."""
    out = []
    for p in parts:
        if p.startswith("="):  # an expression of its own
            out.append(p[1:])
            continue
        pieces = [f"'{x.replace(chr(39), chr(39) * 2)}'" for x in p.split("{id}")]
        out.append(f" || {_ID} || ".join(pieces) + f" || {_NL}")
    return " || ".join(out)


#: A document's text and, behind it, lines that every text operator has something to do with.
SEEDED = f"text || {_NL} || " + _lines(
    "import os{id}", "from x import y", 'require("m")', "#include <a.h>", "use z", "", "", "", "", "def f{id}():", "", "    return 1   ", "function g() {", "", "  x(); // note {id}", "/* block {id} */", "<!-- mark {id} -->",
    "# hash comment", "// slashes {id}", "see https://example.org/p{id}?q=1 and #tag{id} @user{id} at user.{id}@mail.example.org", "on 2024-01-15 at 12:30:45, EMP{id}23 and id_{id}99 of Acme Widgets Corp; 3.14 and {id}", "by John Smith, 110101199003074{id}", "call +1 10.1.2.3 now", "last {id}",
)

#: Of every 97th document a file of a megabyte.
LARGE = f"CASE WHEN doc_id % 97 = 0 THEN repeat('0123456789ab' || {_NL}, 80000 + cast(doc_id % 7 AS int)) ELSE text END"

LANGUAGES = ("python", "javascript", "java", "cpp", "html", "css", "text", "typescript", "c")
EXTENSIONS = {"python": ".py", "javascript": ".js", "java": ".java", "cpp": ".cpp", "html": ".html", "css": ".css", "text": ".txt", "typescript": ".TS", "c": ".c"}
_N = "cast(doc_id % 4 AS int)"
_CODE = {
    "python": _lines("import os, sys # two {id}", "from a.b{id} import c as d", "", f"=repeat({_lines('def run{id}(a, b):', '    if a and b:', '        return a # both', '  # short')}, {_N})", "class C{id}(Base):", "    x = 1", "for y in z:", "    pass", f"=CASE WHEN doc_id % 4 = 3 THEN {_lines('if x:', 'def after(): pass')} ELSE '' END", "LIMIT = 'a#b'", "# TODO later {id}", "w = 2 # ask me.{id}@mail.example.org", "", "", "", "", "end = {id}"),
    "javascript": _lines("import {a} from 'm{id}';", "const q = require('r{id}')", f"=repeat({_lines('function f{id}(a) {', '  if (a && b || c) { return a ? b : c; }', '}', 'const g = (x) => x')}, {_N})", "class K{id} {", "}", "let n = {id}", "call()", "// line {id}", "/* block", " of two */ run();", "// fixme {id}", "/* by user.{id}@mail.example.org */", "url = 'http://x.org/{id}'"),
    "java": _lines("=CASE WHEN doc_id % 2 = 0 THEN 'package p;' || chr(10) ELSE '' END", "import java.util.List{id};", "public final class J{id} {", f"=repeat({_lines('  public static int run(int a) throws E {', '    for (;;) { while (a) { switch (a) {} } }', '    try {} catch (E e) {}', '  }')}, {_N})", "  void none(); // todo {id}", "} // end {id}"),
    "cpp": _lines("#include <vector>", '#include "own{id}.h"', "class P{id} : public Q {", "};", f"=repeat({_lines('int add(int a, int b) const {', '  return a > b ? a : b; /* larger */', '}')}, {_N})", "// done {id}", "using namespace std;"),
    "html": _lines("<html><!-- head {id} -->", "<p>text {id}</p>", "<!-- two", "lines --></html>", "<!-- todo {id} -->", "<!-- of a.{id}@mail.example.org -->"),
    "css": _lines("/* top {id} */", ".a { color: red; } /* in", "two lines */", "#id{id} { margin: 0 }", "/* hack {id} */", "/* by c.{id}@mail.example.org */"),
    "text": _lines("# title {id}", "// slash {id}", "plain words {id}", "# TODO {id}", "=repeat('wide ', 30) || chr(10)"),
}
_CODE["typescript"], _CODE["c"] = _CODE["javascript"], _CODE["cpp"]
#: Which language a document plays, its code, path and further columns.
LANGUAGE = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LANGUAGES)) + " END"
CONTENT = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN {_CODE[x]}" for i, x in enumerate(LANGUAGES)) + " END"
EXTENSION = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{EXTENSIONS[x]}'" for i, x in enumerate(LANGUAGES)) + " END"
PATH = f"CASE WHEN doc_id % 5 = 0 THEN 'tests/Test_' WHEN doc_id % 5 = 1 THEN 'src/My Spec ' ELSE 'src/main_' END || {_ID} || {EXTENSION}"
BINARY = "doc_id % 31 = 7"

#: The same in DuckDB, as tables to put behind WITH.
SEEDED_SQL = f"seeded AS (SELECT doc_id, lang, source, {SEEDED} AS text FROM documents)"
LARGE_SQL = f"seeded AS (SELECT doc_id, lang, source, {LARGE} AS text FROM documents)"
CODE_SQL = f"made AS (SELECT doc_id, {LANGUAGE} AS language, {EXTENSION} AS extension, {PATH} AS path, {CONTENT} AS text, {BINARY} AS is_binary FROM documents)"


def in_language_sql(language: str) -> str:
    return f"seeded AS (SELECT doc_id, lang, source, {_CODE[language]} AS text FROM documents)"


def in_language(docs: DataFrame, language: str) -> DataFrame:
    """Every document as code of one language."""
    return docs.withColumn("text", F.expr(_CODE[language]))


def seeded(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.expr(SEEDED))


def large(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.expr(LARGE))


def code_records(docs: DataFrame) -> DataFrame:
    own = docs.selectExpr("doc_id AS ord", f"{PATH} AS path", f"{EXTENSION} AS extension", f"{LANGUAGE} AS language", f"{CONTENT} AS content", f"{BINARY} AS is_binary", "cast(doc_id AS double) AS modified_time")
    return own.withColumns({"size": F.octet_length("content").cast("long"), "lines": n_lines(F.col("content"))})
