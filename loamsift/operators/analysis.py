"""Quality checks, scores, and rollups by language and over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import SPACE, let, lines, not_blank, once, readability, strip, text_features
from .structure import code_structure

LONG_LINE, LARGE_FILE, MOST_LISTED, TOP_IMPORTS = 120, 1_024_000, 100, 10
_OPENERS = "class def for from if import try while with".split()
_STATEMENTS = "class const for function if let switch var while".split()
_LEVELS = [("low", None, 5), ("medium", 5, 15), ("high", 15, 30), ("very_high", 30, None)]
TEXTS = {"long_line": "line of more than 120 characters", "too_many_empty_lines": "more than two blank lines in a row", "large_file": "file of more than 1000 KiB", "indentation_error": "indent doesn't follow the line before", "missing_semicolon": "a semicolon may be missing", "missing_package": "no package declaration"}


def _not_binary(records: DataFrame) -> Column:
    return ~F.coalesce("is_binary", F.lit(False)) if "is_binary" in records.columns else F.lit(True)


def with_features(records: DataFrame) -> DataFrame:
    """Records with `code_structure` and `readability`, which the rollups read."""
    use = _not_binary(records)
    t = F.when(use, F.col("content"))
    return records.withColumns({"code_structure": code_structure(t, F.col("language")), "readability": once(readability(t))})


def with_text_features(records: DataFrame) -> DataFrame:
    """with_features(), and `text_features`: what extraction keeps of each text; null for binary records."""
    t = F.when(_not_binary(records), F.col("content"))
    return with_features(records).withColumn("text_features", F.when(t.isNotNull(), text_features(t, F.col("language"))))


def _issue(kind: str, line: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.col("path").alias("file"), line.cast("int").alias("line"), F.lit(TEXTS[kind]).alias("message"))


def _line_issues(ls: Column, kind: str, test) -> Column:
    return F.filter(F.transform(ls, lambda x, i: F.when(test(x, i), _issue(kind, i + 1))), lambda x: x.isNotNull())


def _starts(x: Column, words: list[str]) -> Column:
    return x.rlike(r"\A(?:" + "|".join(words) + ")")


def issues(t: Column, language: Column, size: Column) -> Column:
    """array<struct<type,file,line,message>>: long lines, blank runs, size, then the language's own check."""
    return let(lines(t), lambda ls: _issues(t, ls, language, size))


def _issues(t: Column, ls: Column, language: Column, size: Column) -> Column:

    def blank(i: Column) -> Column:
        return (i >= 0) & ~not_blank(F.coalesce(F.get(ls, i), F.lit("")))

    def indent(x: Column) -> Column:
        return F.length(x) - F.length(F.regexp_replace(x, rf"(?U)\A{SPACE}+", ""))

    def misplaced(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(ls, i - 1))
        top = not_blank(x) & ~x.rlike(r"\A[ \t]") & _starts(strip(x), _OPENERS)
        return top & F.coalesce(not_blank(before) & F.endswith(before, F.lit(":")) & (indent(x) != indent(before) + 4), F.lit(False))

    def open_ended(x: Column, i: Column) -> Column:
        s = strip(x)
        return not_blank(x) & ~s.rlike(r"[;{}:,]\z") & ~_starts(s, _STATEMENTS)

    none = F.array().cast("array<struct<type:string,file:string,line:int,message:string>>")
    general = F.concat(
        _line_issues(ls, "long_line", lambda x, i: F.length(x) > LONG_LINE),
        _line_issues(ls, "too_many_empty_lines", lambda x, i: blank(i) & blank(i - 1) & blank(i - 2)),
        F.when(size > LARGE_FILE, F.array(_issue("large_file", F.lit(0)))).otherwise(none),
    )
    own = F.when(language == "python", _line_issues(ls, "indentation_error", misplaced)).when(language.isin("javascript", "typescript"), _line_issues(ls, "missing_semicolon", open_ended))
    own = own.when((language == "java") & ~F.startswith(strip(t), F.lit("package ")), F.array(_issue("missing_package", F.lit(1)))).otherwise(none)
    return F.concat(general, own)


def exploded_issues(records: DataFrame, order_col: str = "ord") -> DataFrame:
    """language, the record's order, seq, type, file, line, message: a row for each issue."""
    found = records.where(_not_binary(records)).select("language", order_col, F.posexplode(issues(F.coalesce("content", F.lit("")), F.col("language"), F.coalesce("size", F.lit(0)))).alias("seq", "i"))
    return found.select("language", order_col, "seq", "i.*")


def issue_counts(records: DataFrame, order_col: str = "ord") -> DataFrame:
    return exploded_issues(records, order_col).groupBy("language", "type").agg(F.count("*").alias("n"))


def first_issues(records: DataFrame, most: int = MOST_LISTED, order_col: str = "ord") -> DataFrame:
    rank = F.row_number().over(W.partitionBy("language").orderBy(order_col, "seq"))
    return exploded_issues(records, order_col).withColumn("rank", rank).where(F.col("rank") <= most)


def language_stats(records: DataFrame) -> DataFrame:
    own = records.where(_not_binary(records))
    n, li, s = F.count("*"), F.sum(F.coalesce("lines", F.lit(0))), F.sum(F.coalesce("size", F.lit(0)))
    return own.groupBy("language").agg(n.alias("file_count"), li.alias("total_lines"), s.alias("total_size"), (li / n).alias("avg_lines_per_file"), (s / n).alias("avg_size_per_file"))


def _n(field: str) -> Column:
    return F.coalesce(F.size(F.col(f"code_structure.{field}")), F.lit(0))


def structure_rollup(featured: DataFrame) -> DataFrame:
    java, c = F.col("language") == "java", F.col("language").isin("c", "cpp")
    known = F.col("language").isin("python", "javascript", "typescript", "java", "c", "cpp")
    positive = lambda x: F.sum(F.when(known, F.greatest(F.lit(0), x)).otherwise(0))
    parts = {"classes": _n("classes"), "functions": F.when(java, _n("methods")).otherwise(_n("functions")), "imports": F.when(c, _n("includes")).otherwise(_n("imports"))}
    own = featured.where(_not_binary(featured))
    return own.groupBy("language").agg(*[positive(v).alias(f"total_{k}") for k, v in parts.items()], *[(positive(v) / F.count("*")).alias(f"avg_{k}_per_file") for k, v in parts.items()])


def _complexity() -> Column:
    return F.coalesce("code_structure.complexity", F.lit(0))


def _in_level(x: Column, low: int | None, high: int | None) -> Column:
    return (F.lit(True) if low is None else x > low) & (F.lit(True) if high is None else x <= high)


def complexity_rollup(featured: DataFrame) -> DataFrame:
    """By language; each level's count, null where there is none."""
    x = _complexity()
    levels = [F.nullif(F.count_if(_in_level(x, low, high)), F.lit(0)).alias(name) for name, low, high in _LEVELS]
    return featured.where(_not_binary(featured)).groupBy("language").agg(F.sum(x).alias("total_complexity"), F.avg(x).alias("avg_complexity"), F.max(x).alias("max_complexity"), *levels)


def dependency_rollup(featured: DataFrame, order_col: str = "ord") -> DataFrame:
    """language, module, n, rank, total_imports, unique_imports: ranks by count, then by who came first."""
    i = featured.where(_not_binary(featured)).select("language", order_col, F.posexplode("code_structure.imports").alias("seq", "i"))
    i = i.select("language", order_col, "seq", F.col("i.module").alias("module")).where("module <> ''")
    per = i.groupBy("language", "module").agg(F.count("*").alias("n"), F.min(F.struct(order_col, "seq")).alias("first"))
    rank = F.row_number().over(W.partitionBy("language").orderBy(F.desc("n"), "first"))
    total = per.groupBy("language").agg(F.sum("n").alias("total_imports"), F.count("*").alias("unique_imports"))
    ranked = per.select("language", "module", "n", rank.alias("rank"))  # a filter on rank, as for a report, reaches the window
    return ranked.join(total, "language").select("language", "module", "n", "rank", "total_imports", "unique_imports")


def overall(featured: DataFrame, order_col: str = "ord") -> DataFrame:
    """One row over all languages; files without a parsed structure have complexity 0."""
    own = featured.where(_not_binary(featured))
    n_issues = F.size(issues(F.coalesce("content", F.lit("")), F.col("language"), F.coalesce("size", F.lit(0))))
    n, i, c = F.count("*"), F.coalesce(F.sum(n_issues), F.lit(0)), F.coalesce(F.sum(_complexity()), F.lit(0))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return own.agg(n.alias("total_files"), total("lines").alias("total_lines"), total("size").alias("total_size"), i.alias("total_issues"), c.alias("total_complexity"), F.coalesce(F.try_divide(i, n), F.lit(0.0)).alias("avg_issues_per_file"), F.coalesce(F.try_divide(c, n), F.lit(0.0)).alias("avg_complexity_per_file"), F.count_distinct("language").alias("language_count"))


def language_share(records: DataFrame) -> DataFrame:
    per = records.groupBy("language").agg(F.count("*").alias("n"))
    return per.select("language", "n", (F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("percent")).orderBy(F.desc("n"), "language")


def _step_of(v: Column) -> Column:
    """A number that grows with v: 256 for each power of two, so that values can be counted by it before they are ordered."""
    up = lambda x: F.floor(F.log2(x) * 256) + 300_000
    return F.when(v > 0, up(v)).when(v < 0, -up(-v)).otherwise(F.lit(0).cast("long"))


def distributions(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """metric, n, min, max, mean, median, q1, q3, std of each named value. q1 and q3 are the values at places n div 4 and
    3n div 4, counted from 0; std is the population's. No row for no values.

    Values are counted, the counts are summed by steps of the value, of which there are some thousands at most, and only the
    values of one step are ordered in one task.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("v")) for k, v in values.items()])
    per = df.select(F.inline(pairs)).where("v is not null").groupBy("metric", "v").agg(F.count("*").alias("k"))
    n, v, k = F.col("n"), F.col("v"), F.col("k")
    # marked, so that no filter on the step reaches below the counting: else its three readers would each count the texts anew
    per = per.withColumn("step", once(_step_of(v)))
    steps = per.groupBy("metric", "step").agg(F.sum("k").alias("own"))
    whole = W.partitionBy("metric")
    steps = steps.select("metric", "step", (F.sum("own").over(whole.orderBy("step")) - F.col("own")).alias("before"), F.sum("own").over(whole).alias("n"))
    upto = F.sum("k").over(W.partitionBy("metric", "step").orderBy("v"))
    c = per.join(steps, ["metric", "step"]).withColumn("upto", F.col("before") + upto)
    at = lambda place: F.min(F.when(F.col("upto") > place, v))
    mean = F.sum(v * k) / F.first("n")
    places = c.groupBy("metric", "n").agg(F.min("v").alias("min"), F.max("v").alias("max"), mean.alias("mean"), at(F.floor((n - 1) / 2)).alias("m0"), at(F.floor(n / 2)).alias("m1"), at(F.floor(n / 4)).alias("q1"), at(F.floor(n * 3 / 4)).alias("q3"))
    # by the mean first: the plain sum of squares would lose digits
    dev = per.join(F.broadcast(places.select("metric", "n", "mean")), "metric").groupBy("metric").agg(F.sqrt(F.sum((v - F.col("mean")) ** 2 * k) / F.first("n")).alias("std"))  # a row for each metric
    return places.join(dev, "metric").select("metric", "n", "min", "max", "mean", ((F.col("m0") + F.col("m1")) / 2).alias("median"), "q1", "q3", "std")


def distribution(df: DataFrame, value: Column) -> DataFrame:
    """The one row of distributions() without its name; none for no values."""
    return distributions(df, {"value": value}).drop("metric")


def _steps(x: Column, steps: list[tuple[float, float]]) -> Column:
    """What is taken off: of the first limit that x exceeds."""
    out = None
    for limit, less in steps:
        out = F.when(x > limit, less) if out is None else out.when(x > limit, less)
    return out.otherwise(0.0)


KIB = 1024


def quality_score(size: Column, n_lines: Column, complexity: Column, n_issues: Column = None) -> Column:
    i = F.lit(0) if n_issues is None else n_issues
    off = _steps(size, [(1000 * KIB, 20.0), (500 * KIB, 10.0)]) + _steps(n_lines, [(1000, 15.0), (500, 8.0)]) + _steps(complexity, [(20, 25.0), (10, 15.0), (5, 8.0)])
    return F.greatest(F.lit(0.0), F.lit(100.0) - off - F.when(i > 10, 20.0).when(i > 5, 10.0).otherwise(i * 2.0))


def maintainability_score(size: Column, n_lines: Column, complexity: Column, n_functions: Column) -> Column:
    off = _steps(size, [(2000 * KIB, 30.0), (1000 * KIB, 20.0), (500 * KIB, 10.0)]) + _steps(n_lines, [(2000, 25.0), (1000, 15.0), (500, 8.0)])
    off = off + _steps(complexity, [(30, 35.0), (20, 25.0), (10, 15.0), (5, 8.0)]) + _steps(n_functions, [(50, 20.0), (30, 12.0), (20, 6.0)])
    return F.greatest(F.lit(0.0), F.lit(100.0) - off)


def readability_score(flesch: Column, fk: Column) -> Column:
    """Null without figures, so that binary files count neither as easy nor as hard to read."""
    base = F.when(flesch >= 90, 100.0).when(flesch >= 80, 90.0).when(flesch >= 70, 80.0).when(flesch >= 60, 70.0).when(flesch >= 50, 60.0).when(flesch >= 30, 50.0).otherwise(30.0)
    more = F.when(fk <= 6, 10.0).when(fk <= 8, 5.0).when(fk >= 16, -20.0).when(fk >= 12, -10.0).otherwise(0.0)
    return F.when(flesch.isNotNull() & fk.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), base + more)))


def scores(featured: DataFrame) -> DataFrame:
    size, n, c = F.coalesce("size", F.lit(0)), F.coalesce("lines", F.lit(0)), _complexity()
    return featured.withColumns({"quality_score": quality_score(size, n, c), "maintainability_score": maintainability_score(size, n, c, F.greatest(F.lit(0), _n("functions"))), "readability_score": readability_score(F.col("readability.flesch"), F.col("readability.fk"))})


def _is_test() -> Column:
    return F.lower("path").rlike("test|spec")


def test_coverage(records: DataFrame) -> DataFrame:
    own = records.where(_not_binary(records))
    t, s = F.count_if(_is_test()), F.count_if(~_is_test())
    ratio = F.coalesce(F.try_divide(t.cast("double"), s), F.lit(0.0))
    return own.agg(t.alias("test_files"), s.alias("source_files"), ratio.alias("test_ratio"), F.least(F.lit(100.0), ratio * 100.0).alias("test_coverage_estimate"))


def corpus_metrics(featured: DataFrame) -> DataFrame:
    """One row: the means and counts of scores and complexities over the corpus."""
    s, x = scores(featured), _complexity()
    q, m, r = F.col("quality_score"), F.col("maintainability_score"), F.col("readability_score")
    return s.agg(
        F.count("*").alias("total_files"), F.sum("lines").alias("total_lines"), F.sum("size").alias("total_size"), F.avg("lines").alias("avg_lines_per_file"), F.avg("size").alias("avg_size_per_file"),
        F.avg(q).alias("avg_quality_score"), F.sum(x).alias("total_complexity"), F.avg(x).alias("avg_complexity"), F.max(x).alias("max_complexity"), F.min(x).alias("min_complexity"),
        *[F.count_if(_in_level(x, low, high)).alias(f"{name}_complexity_files") for name, low, high in _LEVELS],
        F.avg(m).alias("avg_maintainability_score"), F.count_if(m >= 70).alias("maintainable_files"), F.count_if(m < 50).alias("difficult_to_maintain_files"),
        F.avg(r).alias("avg_readability_score"), F.count_if(r >= 80).alias("highly_readable_files"), F.count_if(r < 50).alias("difficult_to_read_files"),
    )


def score_distributions(featured: DataFrame) -> DataFrame:
    """distributions() of the three scores and of complexity."""
    s = scores(featured)
    return distributions(s, {"quality": F.col("quality_score"), "complexity": _complexity(), "maintainability": F.col("maintainability_score"), "readability": F.col("readability_score")})


def language_totals(records: DataFrame) -> DataFrame:
    """language, files, lines, size; binary files too, unlike language_stats()."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return records.groupBy("language").agg(F.count("*").alias("files"), total("lines").alias("lines"), total("size").alias("size"))


def analyse(records: DataFrame, order_col: str = "ord") -> dict:
    """The whole analysis as a dict for the reports. Only rollups reach the driver: a row for each language at most, and the
    first MOST_LISTED issues of each."""
    f = with_features(records).persist()
    try:

        def row(df: DataFrame) -> dict:
            first = df.first()
            return first.asDict(True) if first else {}

        by: dict[str, dict] = {}
        for part, df in (("basic_stats", language_stats(f)), ("structure", structure_rollup(f)), ("complexity", complexity_rollup(f))):
            for r in df.collect():
                by.setdefault(r["language"], {})[part] = {k: v for k, v in r.asDict().items() if k != "language" and v is not None}
        for r in issue_counts(f, order_col).collect():
            by[r["language"]].setdefault("issues", {})[r["type"]] = r["n"]
        for r in first_issues(f, MOST_LISTED, order_col).orderBy("language", "rank").collect():
            by[r["language"]].setdefault("first_issues", []).append({k: r[k] for k in ("type", "file", "line", "message")})
        for r in dependency_rollup(f, order_col).where(F.col("rank") <= TOP_IMPORTS).orderBy("language", "rank").collect():
            by[r["language"]].setdefault("imports", []).append([r["module"], r["n"]])
        corpus = row(corpus_metrics(f))
        spread = {r["metric"]: {k: v for k, v in r.asDict().items() if k != "metric"} for r in score_distributions(f).collect()}
        return {
            "overall": row(overall(f, order_col)) | {"language_distribution": {k: v["basic_stats"]["file_count"] for k, v in by.items() if "basic_stats" in v}}, "by_language": by, "metrics": corpus, "test_coverage": row(test_coverage(f)),
            "all_files_by_language": {r["language"]: {k: r[k] for k in ("files", "lines", "size")} for r in language_totals(f).collect()}, "distributions": spread,
            "size_distribution": row(distribution(f, F.col("size"))), "line_distribution": row(distribution(f, F.col("lines"))), "file_count": corpus["total_files"], "language_count": len(by),
        }
    finally:
        f.unpersist()
