"""Command line: python -m loamsift {repo,data,config,pipeline} ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .plans.config import Config, pipeline_errors
from .sources.registry import Registry


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("loamsift").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(x) -> None:
    print(json.dumps(x, ensure_ascii=False, indent=2, default=str))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loamsift")
    p.add_argument("--config", default="config.yaml")
    p.add_argument("--data", default="data", help="folder of the registry and of outputs")
    top = p.add_subparsers(dest="group", required=True)

    def group(name: str):
        return top.add_parser(name).add_subparsers(dest="command", required=True)

    def command(to, name: str, /, *names: str, **options):
        c = to.add_parser(name)
        for n in names:
            c.add_argument(n)
        for n, o in options.items():
            c.add_argument("--" + n.replace("_", "-"), **o)
        return c

    flag = {"action": "store_true"}
    repo = group("repo")
    command(repo, "add", "url", name={}, branch={"default": "main"}, copy=flag)
    command(repo, "list", type={})
    command(repo, "update", "name")
    command(repo, "remove", "name", files=flag)
    command(repo, "cleanup")
    data = group("data")
    most = {"type": int, "help": "take only so many files, the first by path"}
    command(data, "extract", "name", output={}, max_files=most)
    command(data, "clean", "name", output={}, max_files=most)
    command(data, "deduplicate", "name", output={}, strategy={"default": None}, dry_run=flag)
    command(data, "clean-metrics", "name", output={}, dry_run=flag, thresholds={}, max_files=most)
    command(data, "analyze-metrics", "name", output={}, thresholds={})
    command(data, "analyze", "name", format={"default": "comprehensive"})
    command(data, "verify", "name", hashes={"required": True, "help": "JSON Lines of path and hash"})
    conf = group("config")
    command(conf, "get", "key")
    command(conf, "set", "key", "value")
    for n in ("list", "validate", "info"):
        command(conf, n)
    for n in ("export", "import", "generate"):
        command(conf, n, "file")
    command(conf, "wizard")
    pipe = group("pipeline")
    command(pipe, "list-pipelines")
    command(pipe, "validate", "pipeline")
    command(pipe, "dry-run", "pipeline")
    command(pipe, "run", "name", pipeline={}, output={})
    command(pipe, "add", "pipeline", "file")
    command(pipe, "update", "pipeline", "file")
    command(pipe, "remove", "pipeline")
    command(pipe, "batch", pipeline={}, type={}, output={}, names={"nargs": "*"})
    return p


def _repo(a: argparse.Namespace, r: Registry) -> None:
    if a.command == "add":
        _show(r.add(a.url, a.name, a.branch, a.copy))
    elif a.command == "list":
        _show(r.list(a.type))
    elif a.command == "update":
        _show(r.update(a.name))
    elif a.command == "remove":
        r.remove(a.name, a.files)
    else:
        _show(r.cleanup())


def _data(a: argparse.Namespace, c: Config, r: Registry) -> None:
    from .operators import analysis, dedup, masking, metrics, reports
    from .plans.pipeline import OPERATORS, extractor, order_of
    from .sources import files, jsonl

    spark = _spark()
    records = files.first_files(extractor(spark, {a.name: r.path(a.name)})(c.values["extraction"]), getattr(a, "max_files", None))
    target = getattr(a, "output", None) or files.below(a.data, a.command, a.name)
    own = c.values["file_metrics_cleaning"]["thresholds"] | (json.loads(Path(a.thresholds).read_text()) if getattr(a, "thresholds", None) else {})
    limits = metrics.Thresholds.of(own)
    if a.command == "extract":
        jsonl.write(analysis.with_text_features(records), target)
    elif a.command == "clean":
        own = c.values["jsonl_cleaning"]
        done = masking.clean_records(records, own["enable_comment_cleaning"], own["enable_desensitization"])
        jsonl.write(done, target)
        _show(masking.cleaning_totals(done).first().asDict())
    elif a.command == "deduplicate":
        own = c.values["deduplication"] | ({"keep_strategy": a.strategy} if a.strategy else {})
        _show(dedup.duplicate_report(records, *dedup.settings(own)[::2]).first().asDict())
        if not a.dry_run:
            jsonl.write(OPERATORS["deduplication"](records, own), target)
    elif a.command == "clean-metrics":
        _show(metrics.metric_summary(records, limits).first().asDict())
        _show([x.asDict() for x in metrics.violations_by_rule(records, limits).collect()])
        if not a.dry_run:
            jsonl.write(metrics.clean_by_metrics(records, limits), target)
    elif a.command == "analyze-metrics":
        totals, violations = metrics.analyse_metrics(files.source_files(spark, r.path(a.name)), limits)
        jsonl.write(violations, target)
        _show(totals | {"violations": target})
    elif a.command == "verify":
        wrong = files.verify_files(records, jsonl.read(spark, a.hashes, "path string, hash string")).where("not verified")
        _show({"files_that_differ": wrong.count(), "first": [x.asDict() for x in wrong.orderBy("path").limit(5).collect()]})
    else:
        _show(reports.write(analysis.analyse(records, order_of(records)[-1]), a.format, Path(a.data) / "reports"))


def _config(a: argparse.Namespace, c: Config) -> int:
    if a.command == "get":
        _show(c.get(a.key))
    elif a.command == "set":
        c.set(a.key, a.value)
        c.save()
    elif a.command == "list":
        _show(c.values)
    elif a.command == "validate":
        _show(c.errors())
        return int(bool(c.errors()))
    elif a.command == "info":
        _show(c.info())
    elif a.command == "export":
        c.save(a.file)
    elif a.command == "import":
        Config(path=a.file).save(c.path)
    elif a.command == "generate":
        Config.template().save(a.file)
    else:
        for key in ("extraction.file_types", "extraction.max_file_size", "deduplication.hash_algorithm", "pipeline.default_pipeline"):
            if answer := input(f"{key} [{c.get(key)}]: ").strip():
                c.set(key, answer)
        c.save()
    return 0


def _pipeline(a: argparse.Namespace, c: Config, r: Registry) -> int:
    from .plans import pipeline as p

    if a.command == "list-pipelines":
        _show({k: v.get("description", "") for k, v in c.get("pipeline.pipelines").items()})
    elif a.command == "validate":
        _show(wrong := pipeline_errors(c.pipeline(a.pipeline)))
        return int(bool(wrong))
    elif a.command == "dry-run":
        _show(p.dry_run(c, a.pipeline))
    elif a.command == "run":
        return _shown(p.run(_spark(), c, {a.name: r.path(a.name)}, a.pipeline, a.output or a.data))
    elif a.command in ("add", "update"):
        c.add_pipeline(a.pipeline, json.loads(Path(a.file).read_text("utf-8")), a.command == "update")
        c.save()
    elif a.command == "remove":
        c.remove_pipeline(a.pipeline)
        c.save()
    else:
        names = [n for n in r.list(a.type) if r.valid(n) and (not a.names or n in a.names)]
        if not names:
            print("no repositories", file=sys.stderr)
            return 1
        return _shown(p.batch(_spark(), c, {n: r.path(n) for n in names}, a.pipeline, a.output or a.data))
    return 0


def _shown(report: dict) -> int:
    from .plans.pipeline import first_errors

    _show(report)
    for line in first_errors(report):
        print(line, file=sys.stderr)
    return int(not report["success"])


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    c, r = Config(path=a.config), Registry(a.data)
    if a.group == "repo":
        _repo(a, r)
        return 0
    if a.group == "data":
        _data(a, c, r)
        return 0
    return _config(a, c) if a.group == "config" else _pipeline(a, c, r)
