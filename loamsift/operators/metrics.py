"""Document metrics, the rules on them, and what the rules lead to."""

from __future__ import annotations

from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow, by_parts
from ..functions.patterns import HEX
from ..functions.text import BREAK, SPACE, let, lines, not_blank, once


@dataclass(frozen=True)
class Thresholds:
    max_file_size: float = 1 << 20
    max_line_count: float = 10_000
    max_line_length: float = 500
    min_comment_percentage: float = 0
    max_comment_percentage: float = 100
    max_digit_percentage: float = 50
    max_hex_percentage: float = 30
    max_average_line_length: float = 200

    @classmethod
    def of(cls, config: dict | None) -> Thresholds:
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (config or {}).items() if k in names})


#: (rule, metric, threshold, how many times the threshold is high severity)
CLEAN_RULES = [("max_line_length", "max_line_length", 1.5), ("max_file_size", "file_size", 2.0), ("max_line_count", "line_count", 1.5)]
REMOVE_RULES = [("max_digit_percentage", "digit_percentage", "high"), ("max_hex_percentage", "hex_percentage", "medium"), ("max_average_line_length", "average_line_length", "medium")]

_C_LIKE = ("//", "/*", "*/")
_HASH, _MARKUP, _STAR = ("#", None, None), (None, "<!--", "-->"), (None, "/*", "*/")
#: extension -> (single, block start, block end); the look-up minds case
COMMENT_SIGNS: dict[str, tuple[str | None, str | None, str | None]] = {
    **{"." + e: _C_LIKE for e in "c cj cpp cs go h java js jsx kt php rs scala svelte swift ts tsx vue".split()},
    **{"." + e: _HASH for e in "py r sh yaml yml".split()},
    **{"." + e: _MARKUP for e in "html xml".split()},
    ".css": _STAR, ".json": (None, None, None), ".rb": ("#", "=begin", "=end"), ".sql": ("--", "/*", "*/"),
}


def _defines(line: str) -> bool:
    return "def " in line or "class " in line


def likely_docstring(stripped: list[str], i: int, quotes: str) -> bool:
    """Near the top, right after a definition, on a definition's own line, or after imports without a definition between."""
    before = stripped[i - 1] if i else ""
    if i <= 2 or before.endswith(":") and _defines(before) or _defines(stripped[i]) and quotes in stripped[i]:
        return True
    recent = stripped[max(0, i - 5) : i]
    return any(x.startswith(("import ", "from ")) for x in recent) and not any(x.endswith(":") and _defines(x) for x in recent)


def python_comment_lines(rows: list[str]) -> int:
    stripped, n, inside = [x.strip() for x in rows], 0, ""
    for i, x in enumerate(stripped):
        if not x:
            continue
        if inside:
            n += 1
            if inside in x:
                inside = ""
            continue
        quotes = next((q for q in ('"""', "'''") if q in x), "")
        if not quotes:
            n += "#" in x
        elif likely_docstring(stripped, i, quotes):
            n += 1
            if x.count(quotes) != 2:
                inside = quotes
    return n


def general_comment_lines(rows: list[str], single: str | None, start: str | None, end: str | None) -> int:
    n, inside = 0, False
    for x in map(str.strip, rows):
        if not x:
            continue
        if inside:
            n += 1
            inside = not (end and end in x)
        elif start and start in x:
            n += 1
            inside = not (end and end in x and start != end)
        elif single and single in x:
            n += 1
    return n


def comment_line_count(rows: list[str], extension: str | None) -> int:
    if extension == ".py":
        return python_comment_lines(rows)
    return general_comment_lines(rows, *COMMENT_SIGNS.get(extension or "", _HASH))


@arrow("int")
@by_parts
def comment_lines_by_extension(texts: pa.Array, extensions: pa.Array) -> pa.Array:
    return pa.array([None if t is None else comment_line_count(t.splitlines(), e) for t, e in zip(texts.to_pylist(), extensions.to_pylist())], pa.int32())


def comment_lines(ls: Column) -> Column:
    """Lines that begin with any language's comment sign."""
    return F.size(F.filter(ls, lambda x: x.rlike(r"(?U)\A[\s\x1c-\x1f]*(?:#|//|/\*|\*|<!--|--)")))


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double") * 100.0, whole), F.lit(0.0))


def _counts(t: Column, ls: Column, comments: Column, full: Column) -> list[Column]:
    widths = F.transform(ls, F.length)
    n, chars = F.size(ls), F.length(t)
    total = F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)
    return [
        n.alias("line_count"), full.alias("effective_lines"), F.coalesce(F.array_max(widths), F.lit(0)).alias("max_line_length"),
        F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("average_line_length"), comments.alias("comment_lines"), _percent(comments, full).alias("comment_percentage"),
        _percent(F.regexp_count(t, F.lit(r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]")), chars).alias("digit_percentage"), _percent(F.regexp_count(t, F.lit(HEX)), chars).alias("hex_percentage"),
    ]


def content_metrics(t: Column) -> Column:
    """A struct of metrics with `file_size` in characters; null for texts without lines."""
    counted = lambda ls: F.struct(ls.alias("ls"), comment_lines(ls).alias("n"), F.size(F.filter(ls, not_blank)).alias("full"))
    made = let(let(lines(t), counted), lambda p: F.when(F.size(p["ls"]) > 0, F.struct(*_counts(t, p["ls"], p["n"], p["full"]), F.length(t).cast("long").alias("file_size"))))
    return F.when(t.isNotNull(), made)


def file_metrics(t: Column, extension: Column) -> Column:
    """The same with `file_size` in bytes and comments by the extension's signs, as shares of all and of effective lines."""
    # Python's part is an argument: it can't stand within the function
    return let(F.struct(lines(t).alias("ls"), comment_lines_by_extension(t, extension).alias("n")), lambda p: _file_metrics(t, p["ls"], p["n"]))


def _file_metrics(t: Column, ls: Column, comments: Column) -> Column:
    full = F.size(F.filter(ls, not_blank))
    return F.struct(*_counts(t, ls, comments, full), F.octet_length(t).cast("long").alias("file_size"), _percent(comments, F.size(ls)).alias("comment_percentage_by_line"), _percent(comments, F.size(F.filter(ls, not_blank))).alias("comment_percentage_by_effective"))


def _violation(rule: str, threshold: float, actual: Column, severity: Column | str) -> Column:
    s = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(rule).alias("rule"), F.lit(float(threshold)).alias("threshold"), actual.cast("double").alias("actual"), s.alias("severity"))


def violations(m: Column, t: Thresholds = Thresholds()) -> tuple[Column, Column]:
    """Arrays of the broken clean rules and remove rules."""
    clean = []
    for rule, metric, times in CLEAN_RULES:
        most = getattr(t, rule)
        clean.append(F.when(m[metric] > most, _violation(rule, most, m[metric], F.when(m[metric] > most * times, "high").otherwise("medium"))))
    few, many = "min_comment_percentage", "max_comment_percentage"
    c = m["comment_percentage"]
    remove = [F.when(c < getattr(t, few), _violation(few, t.min_comment_percentage, c, "critical")).when(c > getattr(t, many), _violation(many, t.max_comment_percentage, c, "medium"))]
    remove += [F.when(m[metric] > getattr(t, rule), _violation(rule, getattr(t, rule), m[metric], severity)) for rule, metric, severity in REMOVE_RULES]
    return tuple(F.filter(F.array(*x), lambda v: v.isNotNull()) for x in (clean, remove))


def with_metrics(records: DataFrame, thresholds: Thresholds = Thresholds(), metrics: Column | None = None) -> DataFrame:
    """The records with `metrics`, `clean_rules`, `remove_rules`, `all_violations` and `action` (remove, clean or ignore)."""
    usable = ~F.coalesce("is_binary", F.lit(False)) & (F.coalesce("content", F.lit("")) != "") if "is_binary" in records.columns else F.coalesce("content", F.lit("")) != ""
    m = F.when(usable, content_metrics(F.col("content")) if metrics is None else metrics)
    clean, remove = violations(F.col("metrics"), thresholds)
    out = records.withColumn("metrics", once(m)).withColumns({"clean_rules": clean, "remove_rules": remove})
    action = F.when(F.size("remove_rules") > 0, "remove").when(F.size("clean_rules") > 0, "clean").otherwise("ignore")
    return out.withColumns({"all_violations": F.concat("clean_rules", "remove_rules"), "action": F.when(F.col("metrics").isNotNull(), action).otherwise("ignore")})


def with_file_metrics(records: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """with_metrics() for scanned files: sizes in bytes, and comments by the signs of each file's extension."""
    return with_metrics(records, thresholds, file_metrics(F.col("content"), F.col("extension")))


def wrap_long_lines(t: Column, most: int = 500) -> Column:
    """The lines, cut after the last blank or sign within the 50 characters before `most`, or else at `most`, while more than that
    is left. Patterns on the whole text: once line ends are line feeds, a vertical tab can stand for a cut."""
    most = int(most)
    low = max(0, most - 50) + 1
    signed = rf"[^\n]{{{low},{most - 1}}}[,.:;!? \t]|" if low < most else ""
    space = SPACE[1:-1]
    rows = F.regexp_replace(F.regexp_replace(t, BREAK, "\n"), r"\n\z", "")
    rows = F.regexp_replace(rows, rf"(?:\G|(?<=\n))(?=[^\n]{{{most + 1}}})({signed}[^\n]{{{most}}})(?U:[{space}&&[^\n]]*+)", "$1\u000b")
    return F.replace(F.regexp_replace(rows, rf"(?U)[{space}&&[^\n\x0b]]+\x0b", "\u000b"), F.lit("\v"), F.lit("\n"))


def clean_by_metrics(records: DataFrame, thresholds: Thresholds = Thresholds(), keep_ignored: bool = False) -> DataFrame:
    """Without the records to remove, with long lines wrapped in those to clean (`metrics_cleaned`).

    Records that can't be measured (binary or without text) are left out too, unless keep_ignored.
    """
    found = with_metrics(records, thresholds)
    kept = found.where((F.col("action") != "remove") & (F.lit(keep_ignored) | F.col("metrics").isNotNull()))
    clean = F.col("action") == "clean"
    # only texts to clean go through Python
    wrapped = wrap_long_lines(F.when(clean, F.col("content")), int(thresholds.max_line_length))
    out = kept.withColumn("content", F.coalesce(wrapped, "content")).withColumn("metrics_cleaned", clean)
    return out.select(*records.columns, "metrics_cleaned")


AVERAGED = ("line_count", "max_line_length", "average_line_length", "comment_percentage", "digit_percentage", "hex_percentage", "file_size")


def metric_summary(records: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Means of seven metrics, and how many records go beyond five limits."""
    m = with_metrics(records, thresholds).where("metrics is not null")
    over = {"long_line_files": ("max_line_length", thresholds.max_line_length), "large_files": ("file_size", thresholds.max_file_size), "many_line_files": ("line_count", thresholds.max_line_count), "high_digit_files": ("digit_percentage", thresholds.max_digit_percentage), "high_hex_files": ("hex_percentage", thresholds.max_hex_percentage)}
    return m.agg(F.count("*").alias("n_files"), *[F.avg(F.col(f"metrics.{k}").cast("double")).alias(f"avg_{k}") for k in AVERAGED], *[F.count_if(F.col(f"metrics.{k}") > v).alias(name) for name, (k, v) in over.items()])


def violations_by_rule(records: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    found = with_metrics(records, thresholds).select(F.explode("all_violations").alias("v"))
    return found.groupBy(F.col("v.rule").alias("rule"), F.col("v.severity").alias("severity")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule", "severity")


def analyse_metrics(records: DataFrame, thresholds: Thresholds = Thresholds(), by_extension: bool = True) -> tuple[dict, DataFrame]:
    """(totals, violations) of scanned files, none of which is changed. totals: files measured, to remove, to clean and to leave,
    and the means. violations: path, action, rule, threshold, actual, severity, a row for each."""
    found = (with_file_metrics if by_extension else with_metrics)(records, thresholds)
    measured = found.where("metrics is not null")
    count = lambda a: F.count_if(F.col("action") == a)
    totals = measured.agg(F.count("*").alias("total_files"), count("remove").alias("removed_files"), count("clean").alias("cleaned_files"), count("ignore").alias("ignored_files"), *[F.avg(F.col(f"metrics.{k}").cast("double")).alias(f"avg_{k}") for k in AVERAGED]).first().asDict()
    return totals, found.select("path", "action", F.inline("all_violations"))
