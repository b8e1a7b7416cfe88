"""Pipelines as graphs of DataFrames. A plan is lazy: every step reads the steps it depends on. A run writes each step's
records and goes on from what it wrote, so no step is worked out twice."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, cleaning, dedup, masking, metrics
from ..sources import files, jsonl
from .config import Config, execution_order, pipeline_errors

#: method -> the section whose options a step's own ones override
SECTION_OF = {"deduplication": "deduplication", "content_cleaning": "cleaning", "jsonl_cleaning": "jsonl_cleaning", "file_metrics_cleaning": "file_metrics_cleaning", "duplicate_analysis": "deduplication", "metrics_analysis": "file_metrics_cleaning", "code_analysis": "analysis"}


def order_of(df: DataFrame) -> tuple[str, ...]:
    """What the records are in order of: their own `ord`, or else repository and path."""
    return ("ord",) if "ord" in df.columns else tuple(c for c in ("source_repo", "path") if c in df.columns)


def _dedup(df: DataFrame, c: dict) -> DataFrame:
    algorithm, _, least = dedup.settings(c)
    return dedup.deduplicate(df, c.get("keep_strategy", "newest"), algorithm, least, order_of(df))


def _limits(c: dict) -> metrics.Thresholds:
    return metrics.Thresholds.of((c.get("thresholds") or {}) | {k: v for k, v in c.items() if k in vars(metrics.Thresholds())})


OPERATORS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "deduplication": _dedup,
    "content_cleaning": lambda df, c: cleaning.clean_records(df, cleaning.Rules.of(c)),
    "jsonl_cleaning": lambda df, c: masking.clean_records(df, c.get("enable_comment_cleaning", True), c.get("enable_desensitization", True)),
    "file_metrics_cleaning": lambda df, c: metrics.clean_by_metrics(df, _limits(c), c.get("keep_ignored", False)),
    "duplicate_analysis": lambda df, c: dedup.duplicate_report(df, dedup.settings(c)[0], dedup.settings(c)[2]),
    "metrics_analysis": lambda df, c: metrics.metric_summary(df, _limits(c)),
    "code_analysis": lambda df, c: analysis.corpus_metrics(analysis.with_features(df)),
}


def register(method: str, operator: Callable[[DataFrame, dict], DataFrame], section: str = "") -> None:
    """Make a step method of one's own."""
    OPERATORS[method], SECTION_OF[method] = operator, section


@dataclass
class Plan:
    """Outputs by step, in execution order; nothing has run yet."""

    name: str
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)

    @property
    def last(self) -> DataFrame:
        return next(reversed(self.outputs.values()))

    def explain(self) -> None:
        for name, df in self.outputs.items():
            print(f"== {name} ==")
            df.explain("formatted")


def _checked(config: Config, name: str | None) -> list[dict]:
    chosen = config.pipeline(name)
    if wrong := pipeline_errors(chosen):
        raise ValueError("; ".join(wrong))
    return execution_order(chosen["steps"])


def _add(out: Plan, step: dict, config: Config, extract: Callable[[dict], DataFrame]) -> DataFrame:
    """One step's records, made from the plan's outputs so far."""
    own = step.get("config") or {}
    if step["type"] == "extractor":
        return extract(config.values["extraction"] | own)
    inputs = [out.outputs[d] for d in step.get("depends_on") or []]
    df = inputs[0] if inputs else next(iter(out.outputs.values()))
    for more in inputs[1:]:
        df = df.unionByName(more, allowMissingColumns=True)
    if not step.get("enabled", True):
        out.skipped.append(step["name"])
        return df
    method = own["method"]
    section = config.values.get(SECTION_OF[method], {})
    return OPERATORS[method](df, section | {k: v for k, v in own.items() if k != "method"})


def plan(config: Config, name: str | None, extract: Callable[[dict], DataFrame]) -> Plan:
    """The pipeline's graph. extract gives the records of an extractor step. Disabled steps pass their input on; a step without
    dependencies that isn't an extractor reads the first extractor's records."""
    steps = _checked(config, name)
    out = Plan(name or config.get("pipeline.default_pipeline"))
    for step in steps:
        out.outputs[step["name"]] = _add(out, step, config, extract)
    return out


def extractor(spark: SparkSession, roots: dict[str, str]) -> Callable[[dict], DataFrame]:
    """Records of all the trees in one DataFrame, with `source_repo`."""

    def of(options: dict) -> DataFrame:
        e = files.Extraction.of(options)
        parts = [files.scan(spark, root, e).withColumn("source_repo", F.lit(name)) for name, root in roots.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return of


MOST_ERRORS = 5


def run(spark: SparkSession, config: Config, roots: dict[str, str], name: str | None = None, output: str | None = None) -> dict:
    """Execute a pipeline over one or many trees at once: each step's records as JSON Lines below `output`, and a report.

    `output` is a folder or the address of one. Each step is read back from what it wrote, so what comes before is worked out
    once. A step that fails fails the run, unless pipeline.continue_on_error; then the steps that depend on it fail with it.
    """
    began, steps, extract = time.time(), _checked(config, name), extractor(spark, roots)
    p = Plan(name or config.get("pipeline.default_pipeline"))
    folder = files.below(output or config.get("pipeline.work_dir"), "pipeline_output", p.name)
    report: dict = {"pipeline": p.name, "repositories": sorted(roots), "steps": [], "success": True}
    for step in steps:
        start, target = time.time(), files.below(folder, step["name"])
        entry = {"step": step["name"], "output": target, "skipped": False, "success": True, "errors": []}
        report["steps"].append(entry)
        try:
            if lost := [d for d in step.get("depends_on") or [] if d not in p.outputs]:
                raise ValueError("needs what failed: " + ", ".join(lost))
            df, seen = _add(p, step, config, extract), Observation()
            entry["skipped"] = step["name"] in p.skipped
            jsonl.write(df.observe(seen, F.count(F.lit(1)).alias("n")), target)
            entry["records"] = seen.get["n"]
            p.outputs[step["name"]] = jsonl.read(spark, target, df.schema, strict=True)
        except Exception as e:
            entry |= {"success": False, "errors": [str(e)[:2000]]}
            report["success"] = False
            if not config.get("pipeline.continue_on_error"):
                _write(spark, report, folder, began)
                raise
        entry["seconds"] = time.time() - start
    _write(spark, report, folder, began)
    return report


def first_errors(report: dict, most: int = MOST_ERRORS) -> list[str]:
    """The first errors of a run, for a listing, and how many there are besides."""
    every = [f"{s['step']}: {e}" for s in report["steps"] for e in s["errors"]]
    return every[:most] + ([f"and {len(every) - most} more"] if len(every) > most else [])


def _write(spark: SparkSession, report: dict, folder: str, began: float) -> None:
    report["seconds"] = time.time() - began
    files.write_text(spark, files.below(folder, "pipeline_report.json"), json.dumps(report, ensure_ascii=False, indent=2, default=str))


def dry_run(config: Config, name: str | None = None) -> list[dict]:
    """What a run would do, step by step, without Spark."""
    chosen = config.pipeline(name)
    return [{"step": s["name"], "type": s["type"], "method": (s.get("config") or {}).get("method"), "enabled": s.get("enabled", True), "reads": s.get("depends_on") or [], "options": s.get("config") or {}} for s in execution_order(chosen["steps"])]


def batch(spark: SparkSession, config: Config, roots: dict[str, str], name: str | None = None, output: str | None = None) -> dict:
    """All trees in one plan, and a summary by repository."""
    report = run(spark, config, roots, name, output)
    last = report["steps"][-1]["output"] if report["steps"] else None
    per: dict[str, int] = {}
    if last and report["success"]:
        df = spark.read.json(last)
        if "source_repo" in df.columns:
            per = {r[0]: r[1] for r in df.groupBy("source_repo").count().collect()}
    report["summary"] = {"total": len(roots), "records": {k: per.get(k, 0) for k in roots}, "steps": {s["step"]: {"success": int(s["success"]), "failed": int(not s["success"])} for s in report["steps"]}}
    _write(spark, report, files.below(output or config.get("pipeline.work_dir"), "pipeline_output", report["pipeline"]), time.time() - report["seconds"])
    return report
