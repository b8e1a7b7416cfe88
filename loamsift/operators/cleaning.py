"""Content cleaning: comments, blank lines, white space, imports, structure, in this order."""

from __future__ import annotations

from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow
from ..functions.text import let, lines, normalize_whitespace, not_blank, remove_empty_lines, strip

C_FAMILY = ("javascript", "typescript", "java", "cpp", "c", "cangjie")
_LINE_COMMENT, _BLOCK_COMMENT, _MARKUP_COMMENT = "(?md)//.*$", r"(?s)/\*.*?\*/", "(?s)<!--.*?-->"


@dataclass(frozen=True)
class Rules:
    remove_comments: bool = False
    remove_blank_lines: bool = False
    normalize_whitespace: bool = False
    remove_imports: bool = False
    preserve_structure: bool = True

    @classmethod
    def of(cls, config: dict | None) -> Rules:
        names = {f.name for f in fields(cls)}
        return cls(**{k: bool(v) for k, v in (config or {}).items() if k in names})

    @property
    def applied(self) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name)]


def strip_python_comments(text: str) -> str:
    """From # to the line's end, outside triple quotes. A line with triple quotes opens or closes them, even if it holds two."""
    out, inside = [], ""
    for line in text.splitlines():
        if inside:
            if inside in line:
                inside = ""
        else:
            inside = next((q for q in ('"""', "'''") if q in line), "")
        out.append(line if inside else line.partition("#")[0] if "#" in line else line)
    return "\n".join(out)


@arrow("string")
def _python_comments(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else strip_python_comments(t) for t in texts.to_pylist()], pa.string())


def remove_comments(t: Column, language: Column) -> Column:
    # Python's worker gets only the Python texts; the other languages stay in the JVM
    python = F.coalesce(_python_comments(F.when(language == "python", t)), t)
    c_like = F.regexp_replace(F.regexp_replace(t, _LINE_COMMENT, ""), _BLOCK_COMMENT, "")
    generic = F.regexp_replace(F.regexp_replace(t, "(?md)^#.*$", ""), "(?md)^//.*$", "")
    return F.when(language == "python", python).when(language.isin(*C_FAMILY), c_like).when(language == "html", F.regexp_replace(t, _MARKUP_COMMENT, "")).when(language == "css", F.regexp_replace(t, _BLOCK_COMMENT, "")).otherwise(generic)


IMPORTS = {"python": ["import ", "from "], "javascript": ["import ", "require("], "typescript": ["import ", "require("], "java": ["import "], "c": ["#include"], "cpp": ["#include"], "cangjie": ["#include", "import ", "use "]}


def _when_language(language: Column, t: Column, by: dict[str, Column]) -> Column:
    out = None
    for name, value in by.items():
        out = F.when(language == name, value) if out is None else out.when(language == name, value)
    return out.otherwise(t)


def _without(t: Column, starts: list[str]) -> Column:
    def other(x: Column) -> Column:
        s, keep = strip(x), F.lit(True)
        for p in starts:
            keep = keep & ~F.startswith(s, F.lit(p))
        return keep

    return F.array_join(F.filter(lines(t), other), "\n")


def remove_imports(t: Column, language: Column) -> Column:
    return _when_language(language, t, {k: _without(t, v) for k, v in IMPORTS.items()})


def keep_structure(t: Column, opener: str) -> Column:
    """Only blank lines right after a line that ends with the opener stay, as empty lines."""

    def kept(ls: Column) -> Column:
        def stays(x: Column, i: Column) -> Column:
            before = F.get(ls, i - 1)
            return not_blank(x) | (F.coalesce(not_blank(before), F.lit(False)) & F.endswith(strip(before), F.lit(opener)))

        return F.transform(F.filter(ls, stays), lambda x: F.when(not_blank(x), x).otherwise(""))

    return F.array_join(let(lines(t), kept), "\n")


def preserve_structure(t: Column, language: Column) -> Column:
    return _when_language(language, t, {"python": keep_structure(t, ":"), **{k: keep_structure(t, "{") for k in ("javascript", "typescript", "cangjie")}})


def clean_content(t: Column, language: Column, rules: Rules = Rules()) -> Column:
    """All of the rules but remove_comments, which clean_records applies first."""
    if rules.remove_blank_lines:
        t = remove_empty_lines(t)
    if rules.normalize_whitespace:
        t = normalize_whitespace(t)
    if rules.remove_imports:
        t = remove_imports(t, language)
    if rules.preserve_structure:
        t = preserve_structure(t, language)
    return t


def cleaning_stats(before: Column, after: Column) -> Column:
    a, b, c, d = F.size(lines(before)), F.size(lines(after)), F.length(before), F.length(after)
    return F.struct(a.alias("original_lines"), b.alias("cleaned_lines"), (a - b).alias("lines_removed"), c.alias("original_chars"), d.alias("cleaned_chars"), (c - d).alias("chars_removed"), F.coalesce(F.try_divide(d.cast("double"), c), F.lit(1.0)).alias("compression_ratio"))


def clean_records(records: DataFrame, rules: Rules = Rules(), keep_original: bool = True) -> DataFrame:
    """Records with cleaned `content`, `original_content`, `cleaning_rules` and `cleaning_stats`; binary ones as they are, with nulls there."""
    use = ~F.coalesce(F.col("is_binary"), F.lit(False)) if "is_binary" in records.columns else F.lit(True)
    language = F.coalesce(F.col("language"), F.lit("unknown"))
    out = records.withColumn("original_content", F.when(use, F.col("content")))
    if rules.remove_comments:  # a step of its own: a call to Python can't stand within the functions of an array's elements
        out = out.withColumn("content", F.when(use, remove_comments(F.col("original_content"), language)).otherwise(F.col("content")))
    out = out.withColumn("content", F.when(use, clean_content(F.col("content"), language, rules)).otherwise(F.col("content")))
    out = out.withColumn("cleaning_rules", F.when(use, F.array(*[F.lit(r) for r in rules.applied]).cast("array<string>")))
    out = out.withColumn("cleaning_stats", F.when(use, cleaning_stats(F.col("original_content"), F.col("content"))))
    return out if keep_original else out.drop("original_content")
