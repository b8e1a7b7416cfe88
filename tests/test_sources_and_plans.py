"""Sources, configuration, pipelines, the command line, streams and the driver's entry points."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loamsift.operators import cleaning, metrics
from loamsift.plans import pipeline
from loamsift.plans.config import Config, coerce, execution_order, pipeline_errors
from loamsift.sources import files, jsonl
from loamsift.sources.registry import Registry, repository_name
from loamsift.streaming import incremental

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture
def tree(tmp_path):
    own = {"a.py": b"import os\r\nx = 1\n", "sub dir/b.js": b"// todo\nlet y = 1;\n", "environment/c.py": b"no", ".git/d.py": b"no", "bin.py": b"\x00\x01", "bad.txt": b"ok \xff\xfe end", "Makefile": b"all:", "big.py": b"z" * 500, "plus+%41.py": b"p", "skip.py": b"s"}
    for name, data in own.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(tmp_path / "tree")


def test_scan(spark, tree):
    e = files.Extraction(exclude_dirs=(".git",), exclude_dir_patterns=("^.*env.*$", "("), exclude_files=("skip.py",), max_file_size=400)
    got = {r["path"]: r for r in files.scan(spark, tree, e).collect()}
    assert set(got) == {"a.py", "sub dir/b.js", "bin.py", "bad.txt", "Makefile", "plus+%41.py"}
    a = got["a.py"]
    assert (a["content"], a["lines"], a["size"], a["language"], a["extension"], a["name"], a["is_binary"]) == ("import os\nx = 1\n", 2, 17, "python", ".py", "a.py", False)
    assert got["bin.py"]["is_binary"] and got["bad.txt"]["content"] == "ok  end" and (got["Makefile"]["extension"], got["Makefile"]["language"]) == ("", "unknown")
    assert Path(a["absolute_path"]).exists() and a["modified_time"] > 1e9
    assert {r["path"] for r in files.scan(spark, tree, files.Extraction(file_types=(".js",))).collect()} == {"sub dir/b.js"}
    assert {r["path"] for r in files.source_files(spark, tree).collect()} == {"a.py", "sub dir/b.js", "environment/c.py", "bin.py", "big.py", "plus+%41.py", "skip.py"}


def test_files_of_any_file_system(spark, tree, tmp_path):
    a, b = files.below(str(tmp_path), "x", "a.txt"), files.below(tmp_path.as_uri(), "x", "b.txt")
    assert files.below("s3a://bucket/p/", "q") == "s3a://bucket/p/q"
    files.write_text(spark, a, "é\n")
    files.copy(spark, a, b)
    assert files.read_text(spark, b) == "é\n" and files.exists(spark, a) and files.info(spark, b)["size"] == 3 and files.info(spark, b)["extension"] == ".txt"
    assert files.listed(spark, files.below(str(tmp_path), "x"), "*.txt") == ["a.txt", "b.txt"]
    files.move(spark, a, files.below(str(tmp_path), "c.txt"))
    assert not files.exists(spark, a) and files.delete(spark, b) and not files.delete(spark, b)
    files.make_folder(spark, files.below(str(tmp_path), "new"))
    assert files.info(spark, files.below(str(tmp_path), "new"))["is_dir"] and files.with_extension("a", "py") == "a.py" == files.with_extension("a.py", ".py")
    r = files.scan(spark, tree, files.Extraction(file_types=(".py",)))
    want = r.select("path", F.when(F.col("path") == "a.py", F.lit("0")).otherwise(F.upper("hash")).alias("hash"))
    got = {x["path"]: x["verified"] for x in files.verify_files(r, want.where("path <> 'big.py'")).collect()}
    assert not got["a.py"] and not got["big.py"] and got["skip.py"]
    assert [x["path"] for x in files.first_files(r, 2).collect()] == ["a.py", "big.py"] and files.first_files(r, None) is r


def test_safe_filename(one):
    assert one(files.safe_filename, ['a<b>:"c', " .x. ", "...", "ok"]) == ["a_b___c", "x", "unnamed", "ok"]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "é"}\n\nnot json\n{"a": 2, "b": null}\n', "utf-8")
    assert jsonl.read(spark, str(p), "a int, b string").count() == 2 and jsonl.count(spark, str(p)) == 3 and not jsonl.is_valid(spark, str(p))
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read(spark, str(p), "a int, b string", strict=True).collect()
    out = str(tmp_path / "out")
    jsonl.write(jsonl.read(spark, str(p), "a int, b string"), out)
    jsonl.write(jsonl.read(spark, str(p), "a int, b string"), out, append=True)
    assert jsonl.is_valid(spark, out) and jsonl.count(spark, out) == 4
    arr = tmp_path / "arr.json"
    jsonl.lines_to_array(spark, out, str(arr), "a int, b string")
    assert len(json.loads(arr.read_text())) == 4
    jsonl.array_to_lines(spark, str(arr), str(tmp_path / "back"))
    assert jsonl.count(spark, str(tmp_path / "back")) == 4
    (tmp_path / "obj.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        jsonl.array_to_lines(spark, str(tmp_path / "obj.json"), str(tmp_path / "no"))
    assert jsonl.load(spark, str(tmp_path), "x", "a int, b string").count() == 2 and jsonl.load(spark, str(tmp_path), "arr").count() == 4
    with pytest.raises(FileNotFoundError):
        jsonl.load(spark, str(tmp_path), "nothing")
    for repo in ("r1", "r 2"):
        (tmp_path / repo).mkdir()
        (tmp_path / repo / "s.jsonl").write_text('{"a": 1}\nbad\n')
    merged = jsonl.merge(spark, [str(tmp_path / r / "s.jsonl") for r in ("r1", "r 2")], "a int")
    assert sorted(r["source_repo"] for r in merged.collect()) == ["r 2", "r1"]


def test_registry(tmp_path, tree):
    r = Registry(tmp_path / "data")
    assert repository_name("git@h.org:o/name.git") == repository_name("https://h.org/o/name/") == "name"
    assert r.add(tree, "t")["type"] == "local_reference" and r.add(tree, "c", copy=True)["type"] == "local"
    with pytest.raises(ValueError):
        r.add(tree, "t")
    again = Registry(tmp_path / "data")
    assert set(again.list()) == {"t", "c"} and set(again.list("local")) == {"c"} and again.valid("t") and again.update("t")
    copied = Path(again.path("c"))
    again.remove("c", files=True)
    assert not copied.exists() and Path(tree).exists() and again.cleanup() == []
    with pytest.raises(KeyError):
        again.get("c")


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("LOAMSIFT_MAX_FILE_SIZE", "77")
    c = Config({"cleaning": {"remove_comments": "yes"}, "file_metrics_cleaning": {"thresholds": {"max_line_length": 9}}, "own": {"k": 1}})
    assert c.get("extraction.max_file_size") == 77 and c.get("cleaning.remove_comments") is True and c.get("own.k") == 1
    assert c.get("file_metrics_cleaning.thresholds")["max_line_length"] == 9 and c.get("file_metrics_cleaning.thresholds")["max_line_count"] == 10_000
    assert c.errors() == [] and c.get("no.such", 5) == 5
    with pytest.raises(ValueError):
        c.set("deduplication.hash_algorithm", "crc")
    c.set("extraction.file_types", ".a, .b")
    assert c.get("extraction.file_types") == [".a", ".b"]
    for name in ("c.yaml", "c.json"):
        c.save(tmp_path / name)
        assert Config(path=tmp_path / name).values == c.values and Config.check_file(tmp_path / name) == []
    c.reset("extraction")
    assert ".py" in c.get("extraction.file_types")
    assert Config({"logging": {"level": "LOUD"}}).errors() and Config.info(c)["extraction"]
    assert [coerce(bool, x) for x in ("true", "off", 1)] == [True, False, True] and coerce(int, "3") == 3 and coerce(dict, '{"a": 1}') == {"a": 1}


def test_pipeline_checks():
    step = lambda n, *d, **o: {"name": n, "type": "cleaner", "depends_on": list(d), "config": {"method": "deduplication"}} | o
    assert [s["name"] for s in execution_order([step("c", "a"), step("a"), step("b", "c")])] == ["a", "c", "b"]
    assert pipeline_errors({"steps": [step("a", "b"), step("b", "a")]}) and pipeline_errors({"steps": [step("a"), step("a")]}) and pipeline_errors({})
    assert pipeline_errors({"steps": [step("a", "zz")]}) and pipeline_errors({"steps": [step("a", type="odd")]})
    c = Config({})
    c.add_pipeline("mine", {"steps": [{"name": "e", "type": "extractor"}]})
    with pytest.raises(ValueError):
        c.add_pipeline("mine", {"steps": [{"name": "e", "type": "extractor"}]})
    c.remove_pipeline("mine")
    with pytest.raises(ValueError):
        c.pipeline("mine")


def test_pipelines_run(spark, tree, tmp_path):
    c = Config({"extraction": {"file_types": [".py", ".js", ".txt"]}, "deduplication": {"min_file_size": 1}})
    for name in ("standard", "quick", "deep_clean", "analysis"):
        report = pipeline.run(spark, c, {"r": tree}, name, str(tmp_path))
        assert report["success"] and all(s["success"] for s in report["steps"]), report
    assert json.loads((tmp_path / "pipeline_output/analysis/pipeline_report.json").read_text())["pipeline"] == "analysis"
    deep = spark.read.json(str(tmp_path / "pipeline_output/deep_clean/content_clean"))
    assert "import" not in deep.where("path = 'a.py'").first()["content"]  # the step's own options take effect
    p = pipeline.plan(c, "standard", pipeline.extractor(spark, {"r": tree, "s": tree}))
    assert list(p.outputs) == ["extract", "content_clean", "metrics_clean", "deduplicate"]
    b = pipeline.batch(spark, c, {"r": tree, "s": tree}, "quick", str(tmp_path / "b"))
    assert b["summary"]["total"] == 2 and sum(b["summary"]["records"].values()) == b["steps"][-1]["records"]
    assert [s["step"] for s in pipeline.dry_run(c, "quick")] == ["extract", "deduplicate"]


def test_own_steps_and_failures(spark, tree, tmp_path):
    def fails(df, options):
        return df.withColumn("x", F.raise_error(F.lit("no"))).select("x")

    pipeline.register("fails", fails)
    from loamsift.plans import config as C

    C.STEP_METHODS["cleaner"] += ("fails",)
    c = Config({})
    c.add_pipeline("bad", {"steps": [{"name": "e", "type": "extractor"}, {"name": "f", "type": "cleaner", "depends_on": ["e"], "config": {"method": "fails"}}, {"name": "off", "type": "cleaner", "enabled": False, "depends_on": ["e"], "config": {"method": "deduplication"}}]})
    with pytest.raises(Exception):
        pipeline.run(spark, c, {"r": tree}, "bad", str(tmp_path))
    c.set("pipeline.continue_on_error", True)
    report = pipeline.run(spark, c, {"r": tree}, "bad", str(tmp_path))
    assert not report["success"] and [s["success"] for s in report["steps"]] == [True, False, True] and report["steps"][2]["skipped"]
    assert len(pipeline.first_errors(report)) == 1 and pipeline.first_errors({"steps": [{"step": "s", "errors": list("abcdefg")}]})[-1] == "and 2 more"


def test_a_run_reads_each_step_once(spark, tree, tmp_path):
    """The extractor's records are made once, though every later step needs them."""
    calls = spark.sparkContext.accumulator(0)

    def counted(df, options):
        def same(batches):
            calls.add(1)
            yield from batches

        return df.mapInArrow(same, df.schema)

    from loamsift.plans import config as C

    pipeline.register("counted", counted)
    C.STEP_METHODS["cleaner"] += ("counted",)
    c = Config({})
    steps = [{"name": "e", "type": "extractor"}, {"name": "a", "type": "cleaner", "depends_on": ["e"], "config": {"method": "counted"}}]
    steps += [{"name": f"d{i}", "type": "cleaner", "depends_on": ["a"], "config": {"method": "deduplication"}} for i in range(3)]
    c.add_pipeline("once", {"steps": steps})
    report = pipeline.run(spark, c, {"r": tree}, "once", tmp_path.as_uri())
    once = calls.value
    assert report["success"] and once == spark.read.json(str(tmp_path / "pipeline_output/once/e")).rdd.getNumPartitions()


def test_command_line(tmp_path, tree):
    def run(*args, code=0):
        p = subprocess.run([sys.executable, "-m", "loamsift", "--config", str(tmp_path / "c.json"), "--data", str(tmp_path / "data"), *args], capture_output=True, text=True, cwd=ROOT, timeout=300)
        assert p.returncode == code, p.stderr
        return p.stdout

    run("config", "generate", str(tmp_path / "c.json"))
    run("config", "set", "deduplication.min_file_size", "1")
    assert run("config", "get", "deduplication.min_file_size").strip() == "1" and run("config", "validate").strip() == "[]"
    run("repo", "add", tree, "--name", "t")
    assert "local_reference" in run("repo", "list")
    assert "deep_clean" in run("pipeline", "list-pipelines") and "extract" in run("pipeline", "dry-run", "quick")
    run("data", "extract", "t", "--max-files", "3")
    (part,) = (tmp_path / "data/extract/t").glob("*.json")
    assert len(part.read_text().splitlines()) == 3 and json.loads(part.read_text().splitlines()[0])["text_features"]["basic_stats"]
    assert '"total_files": 6' in run("data", "analyze-metrics", "t")
    assert "analysis_report" in run("data", "analyze", "t", "--format", "json")


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"content": c, "language": "text", "ts": f"2024-01-01T00:0{m}:00Z"} for c, m in (("a\n\nb", 0), ("a\n\nb", 1), ("c", 6))]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = incremental.read_records(spark, str(src), "content string, language string, ts timestamp")
    for name, df, mode in (("clean", cleaning.clean_records(stream, cleaning.Rules(remove_blank_lines=True)).select("content"), "append"), ("firsts", incremental.first_of_content(stream, "ts").select("content"), "append"), ("counts", incremental.windowed_counts(stream, "ts", "language"), "complete"), ("metered", metrics.with_metrics(stream).select("action"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r[0] for r in spark.table("clean").collect()) == ["a\nb", "a\nb", "c"]
    assert sorted(r[0] for r in spark.table("firsts").collect()) == ["a\n\nb", "c"]
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2] and spark.table("metered").count() == 3


def test_entry_points(spark):
    import __spark_entry__ as E

    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and "exact_dedup_report" in q
    assert E.entry(spark).count() == 1
    r = q["exact_dedup_report"](spark, "/root/testdata/sf0.01").first()
    assert (r["total_files_checked"], r["duplicate_groups"], r["total_duplicate_size"]) == (131, 60, 163_863)


@pytest.mark.parametrize("gone", [("corpus_pipeline.py",), ()])
def test_everything_else_works_without_the_subpackage(tmp_path, gone):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", *gone, "__pycache__"))
    code = "import __spark_entry__ as E; q = E.queries(); assert 'pipeline' not in q and 'exact_dedup_report' in q and set(E.oracle_sql()) <= set(q)"
    p = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert p.returncode == 0, p.stderr


def test_the_guard_hides_no_other_import_error(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    (tmp_path / "r" / "corpus_pipeline.py").write_text("import no_such_library\n")
    p = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert p.returncode != 0 and "no_such_library" in p.stderr


@pytest.mark.parametrize("name", ["dup_list", "content_metrics", "corpus_metrics", "overall_rollup", "preserve_structure_python", "scores"])
def test_queries_against_duckdb(spark, name):
    import duckdb

    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = c.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    shown = lambda v: round(v, 5) if isinstance(v, float) else v
    want = sorted(repr([shown(r[names.index(n)]) for n in sorted(names)]) for r in cur.fetchall())
    got = sorted(repr([shown(r[n]) for n in sorted(names)]) for r in E.queries()[name](spark, sf).collect())
    assert got == want
