"""Comments and personal data: void comments go, personal data in comments and text is replaced by its kind.

Spans are found for each pattern by itself on the original text, so neither one alternation of all patterns nor a chain of
replacements would do; records pass once through an Arrow function with Python's re.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow, by_parts
from ..functions.patterns import COMPANY_ENDINGS, NOTICES, PERSONAL, VOID_COMMENTS, java
from .cleaning import C_FAMILY

RESULT = "struct<content:string,found:long,comments_removed:long,comments_desensitized:long>"
_PERSONAL = {k: (re.compile(p, re.I if fold else 0), mark) for k, (p, fold, mark) in PERSONAL.items()}
_VOID = [re.compile(p, re.I) for p in VOID_COMMENTS]
_NOTICES = [re.compile(p, re.I) for p in NOTICES]
_ENDING = re.compile("(?:" + "|".join(COMPANY_ENDINGS) + r")\b", re.I)
_ENDINGS = tuple(e.lower() for e in COMPANY_ENDINGS)
_FOLDED = str.maketrans("İıſ", "iis")  # what equals an ASCII letter but for case, beyond lower()
_RUN = re.compile(r"[\w\s]+")


def _organizations(text: str):
    """The pattern's matches, sought only where they can be: from a run's start to its last company ending. Elsewhere the
    pattern would try every start against the whole run."""
    p = _PERSONAL["organization"][0]
    low = text.lower() if text.isascii() else text.translate(_FOLDED).lower()
    if len(low) != len(text):  # no letter known does that
        endings = [m.end() for m in _ENDING.finditer(text)]
    else:
        ends = set()
        for e in _ENDINGS:
            at = low.find(e)
            while at >= 0:
                at += len(e)
                if at == len(text) or not (text[at].isalnum() or text[at] == "_"):
                    ends.add(at)
                at = low.find(e, at)
        endings = sorted(ends)
    if not endings:
        return
    i = 0
    for run in _RUN.finditer(text):
        last = -1
        while i < len(endings) and endings[i] <= run.end():
            if endings[i] > run.start():
                last = endings[i]
            i += 1
        if last > 0:
            yield from p.finditer(text, run.start(), min(len(text), last + 1))


_THREE, _NUMBERED = re.compile(r"\d{3}"), re.compile(r"(?:[^\W\d]|[:-])\d{3}")
#: What a text needs for a match of a kind, quick to look for; most texts lack it and are spared the pattern.
_SIGNS: dict[str, Callable[[str], object]] = {
    "url": lambda t: "://" in t,
    "email": lambda t: "@" in t,
    "id_card": re.compile(r"\d{15}").search,
    "phone": re.compile(r"\d{7}").search,
    "ip_address": re.compile(r"\d\.\d").search,
    "employee_id": lambda t: _THREE.search(t) and _NUMBERED.search(t),
    "datetime": re.compile(r"\d[-/:]\d").search,
}


def _matches(kind: str, p: re.Pattern, text: str):
    if kind == "organization":
        return _organizations(text)
    return p.finditer(text) if kind not in _SIGNS or _SIGNS[kind](text) else ()


def personal_spans(text: str) -> list[tuple[int, int, str]]:
    """All matches of all kinds, by start; of equal starts the earlier kind first."""
    out = []
    for kind, (p, mark) in _PERSONAL.items():
        out += [(m.start(), m.end(), mark) for m in _matches(kind, p, text)]
    return sorted(out, key=lambda s: s[0])


def mask(text: str, spans: list[tuple[int, int, str]] | None = None) -> str:
    parts, at = [], 0
    for start, end, mark in personal_spans(text) if spans is None else spans:
        if start >= at:
            parts += [text[at:start], mark]
            at = end
    return "".join([*parts, text[at:]]) or text


def is_void(comment: str) -> bool:
    return not comment.strip() or any(p.search(comment) for p in _VOID)


def _needs_mask(docstring: str) -> bool:
    return any(p.search(docstring) for p in _NOTICES) or any(_PERSONAL[k][0].search(docstring) for k in ("email", "person_name", "employee_id", "phone"))


class Cleaner:
    """One record's comments; counts what it does."""

    def __init__(self) -> None:
        self.removed = self.desensitized = 0

    def _masked(self, comment: str) -> str:
        out = mask(comment)
        self.desensitized += out != comment
        return out

    def comment(self, head: int, tail: int, form: str) -> Callable[[re.Match], str]:
        """For re.sub: what becomes of a comment whose sign has `head` characters before and `tail` behind the text."""

        def of(m: re.Match) -> str:
            body = m[0][head : len(m[0]) - tail].strip()
            if is_void(body):
                self.removed += 1
                return ""
            return form.replace("%", self._masked(body), 1)

        return of

    def block(self, m: re.Match) -> str:
        if is_void(m[0]):
            self.removed += 1
            return ""
        return self._masked(m[0])

    def python(self, text: str) -> str:
        rows, out, i = text.splitlines(), [], 0
        while i < len(rows):
            line = rows[i]
            quotes = next((q for q in ('"""', "'''") if q in line), "")
            if quotes:
                end = i
                if line.count(quotes) != 2:
                    end = next((j for j in range(i + 1, len(rows)) if quotes in rows[j]), len(rows) - 1)
                doc = rows[i : end + 1]
                if _needs_mask("\n".join(doc)):
                    doc = [mask(x) for x in doc]
                    self.desensitized += 1
                out += doc
                i = end + 1
                continue
            code, sign, comment = line.partition("#")
            if not sign:
                out.append(line)
            elif is_void(comment.strip()):
                self.removed += 1
                out.append(code.rstrip())
            else:
                out.append(code + "#" + self._masked(comment))
            i += 1
        return "\n".join(out)

    def clean(self, text: str, language: str) -> str:
        if language == "python":
            return self.python(text)
        if language in C_FAMILY:
            text = re.sub(r"(?s)/\*.*?\*/", self.block, text)
            return re.sub("(?m)//.*$", self.comment(2, 0, "// %"), text)
        if language == "html":
            return re.sub("(?s)<!--.*?-->", self.comment(4, 3, "<!-- % -->"), text)
        if language == "css":
            return re.sub(r"(?s)/\*.*?\*/", self.comment(2, 2, "/* % */"), text)
        for sign in ("#", "//"):
            text = re.sub(f"(?m)^{sign}.*$", self.comment(1, 0, "# %"), text)
        return text


def clean_text(text: str, language: str, comments: bool = True, personal: bool = True) -> tuple[str, int, int, int]:
    """(text, personal matches found, comments removed, comments masked)"""
    c = Cleaner()
    if comments:
        text = c.clean(text, language)
    found = 0
    if personal:
        spans = personal_spans(text)
        found, text = len(spans), mask(text, spans) if spans else text
    return text, found, c.removed, c.desensitized


def masked(t: Column, language: Column, comments: bool = True, personal: bool = True) -> Column:
    @F.arrow_udf(RESULT)
    @by_parts
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        rows = [None if t is None else dict(zip(("content", "found", "comments_removed", "comments_desensitized"), clean_text(t, x or "unknown", comments, personal))) for t, x in zip(texts.to_pylist(), languages.to_pylist())]
        return pa.array(rows, pa.struct([("content", pa.string()), *((k, pa.int64()) for k in ("found", "comments_removed", "comments_desensitized"))]))

    return run.asNondeterministic()(t, language)  # evaluated once, whatever refers to it


@arrow("string")
@by_parts
def mask_text(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else mask(t) for t in texts.to_pylist()], pa.string())


@arrow("int")
@by_parts
def organization_count(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else sum(1 for _ in _organizations(t)) for t in texts.to_pylist()], pa.int32())


def clean_records(records: DataFrame, comments: bool = True, personal: bool = True) -> DataFrame:
    """Records with masked `content`, `original_content`, `has_sensitive_info`, `cleaning_applied`, and the counts of what was done.

    Records without text and binary ones stay as they are, with nulls in the new columns."""
    use = (F.coalesce("content", F.lit("")) != "") & (~F.coalesce("is_binary", F.lit(False)) if "is_binary" in records.columns else F.lit(True))
    out = records.withColumn("__m", masked(F.when(use, F.col("content")), F.coalesce("language", F.lit("unknown")), comments, personal))
    new = {"original_content": F.when(F.col("__m").isNotNull(), F.col("content")), "has_sensitive_info": F.col("__m.found") > 0, "cleaning_applied": F.when(F.col("__m").isNotNull(), True)}
    new |= {"sensitive_info_removed": F.col("__m.found"), "comments_removed": F.col("__m.comments_removed"), "comments_desensitized": F.col("__m.comments_desensitized")}
    return out.withColumns(new).withColumn("content", F.coalesce("__m.content", "content")).drop("__m")


def cleaning_totals(cleaned: DataFrame) -> DataFrame:
    changed = F.col("cleaning_applied") & (F.col("content") != F.col("original_content"))
    return cleaned.agg(F.count("*").alias("total_files"), F.count_if(changed).alias("files_cleaned"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("comments_removed", "comments_desensitized", "sensitive_info_removed")], F.count_if(changed & F.col("has_sensitive_info")).alias("files_with_sensitive_info"))


def personal_counts(t: Column) -> Column:
    """How many matches of each kind a text has; the JVM's counting, without spans."""
    return F.struct(*[F.regexp_count(t, F.lit(java(p, fold))).alias(k) for k, (p, fold, _) in PERSONAL.items()])
