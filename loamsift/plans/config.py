"""Configuration: sections of typed keys with defaults, checks and environment overrides, kept as YAML or JSON."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from ..operators.metrics import Thresholds

try:
    import yaml
except ImportError:  # YAML files need the library; JSON files don't
    yaml = None

REPORTS = tuple("comprehensive csv html json markdown".split())
STEP_METHODS = {"extractor": ("",), "cleaner": ("deduplication", "content_cleaning", "jsonl_cleaning", "file_metrics_cleaning"), "analyzer": ("duplicate_analysis", "metrics_analysis", "code_analysis")}


@dataclass(frozen=True)
class Key:
    kind: type
    default: Any
    about: str
    check: Callable[[Any], bool] | None = None
    env: str | None = None


def _positive(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x > 0


def _strings(x: Any) -> bool:
    return isinstance(x, list) and all(isinstance(i, str) for i in x)


def _one_of(*names: str) -> Callable[[Any], bool]:
    return lambda x: x in names


SECTIONS: dict[str, dict[str, Key]] = {
    "extraction": {
        "file_types": Key(list, sorted("." + e for e in "c cpp go h java js kt php py rb rs swift ts".split()), "endings of files to take", lambda x: _strings(x) and all(i.startswith(".") for i in x)),
        "exclude_dirs": Key(list, sorted(".git .venv __pycache__ build dist node_modules target venv".split()), "directories to leave out", _strings),
        "exclude_dir_patterns": Key(list, [], "patterns of directory names to leave out", _strings),
        "exclude_files": Key(list, sorted(".gitattributes .gitignore LICENSE README.md".split()), "files to leave out", _strings),
        "max_file_size": Key(int, 10 << 20, "bytes", _positive, "LOAMSIFT_MAX_FILE_SIZE"),
    },
    "cleaning": {k: Key(bool, k == "preserve_structure", k.replace("_", " ")) for k in ("remove_comments", "remove_blank_lines", "normalize_whitespace", "remove_imports", "preserve_structure")},
    "deduplication": {
        "hash_algorithm": Key(str, "sha256", "of the content", _one_of("md5", "sha1", "sha256", "sha512")),
        "similarity_threshold": Key(float, 0.95, "of the similar-pairs operator", lambda x: 0 <= x <= 1),
        "min_file_size": Key(int, 100, "bytes", _positive),
        "keep_strategy": Key(str, "newest", "which of a group stays", _one_of("newest", "oldest", "first", "last")),
    },
    "analysis": {k: Key(bool, True, k.replace("_", " ")) for k in ("complexity_analysis", "dependency_analysis", "language_detection", "metrics_calculation")},
    "reporting": {"output_dir": Key(str, "data/reports", "folder"), "default_format": Key(str, "comprehensive", "kind of report", _one_of(*REPORTS)), "supported_formats": Key(list, list(REPORTS), "kinds", lambda x: _strings(x) and set(x) <= set(REPORTS))},
    "logging": {"level": Key(str, "INFO", "level", _one_of("CRITICAL", "DEBUG", "ERROR", "INFO", "WARNING"), "LOAMSIFT_LOG_LEVEL"), "file": Key(str, "data/logs/loamsift.log", "file", None, "LOAMSIFT_LOG_FILE"), "max_file_size": Key(int, 10 << 20, "bytes", _positive), "backup_count": Key(int, 5, "old files", _positive)},
    "performance": {"max_workers": Key(int, 4, "threads of the driver", _positive, "LOAMSIFT_MAX_WORKERS"), "shuffle_partitions": Key(int, 200, "partitions of a shuffle", _positive), "timeout": Key(int, 300, "seconds", _positive, "LOAMSIFT_TIMEOUT")},
    "file_metrics_cleaning": {"thresholds": Key(dict, {k: v for k, v in vars(Thresholds()).items()}, "limits of the metrics"), "keep_ignored": Key(bool, False, "keep records that can't be measured")},
    "jsonl_cleaning": {"enable_comment_cleaning": Key(bool, True, "clean comments"), "enable_desensitization": Key(bool, True, "mask personal data")},
    "pipeline": {"default_pipeline": Key(str, "standard", "name"), "pipelines": Key(dict, {}, "pipelines by name"), "continue_on_error": Key(bool, False, "go on after a failed step"), "work_dir": Key(str, "data", "folder")},
}


def _step(name: str, after: str | None, kind: str = "cleaner", **config: Any) -> dict:
    return {"name": name, "type": kind, "enabled": True, "depends_on": [after] if after else [], "config": config}


def standard_pipelines() -> dict[str, dict]:
    extract = _step("extract", None, "extractor")
    return {
        "standard": {"description": "extract, clean, filter by metrics, dedup", "steps": [extract, _step("content_clean", "extract", method="content_cleaning"), _step("metrics_clean", "content_clean", method="file_metrics_cleaning"), _step("deduplicate", "metrics_clean", method="deduplication", keep_strategy="newest")]},
        "quick": {"description": "extract and dedup", "steps": [extract, _step("deduplicate", "extract", method="deduplication")]},
        "deep_clean": {"description": "every cleaner", "steps": [extract, _step("deduplicate", "extract", method="deduplication"), _step("content_clean", "deduplicate", method="content_cleaning", remove_comments=True, remove_imports=True, normalize_whitespace=True), _step("jsonl_clean", "content_clean", method="jsonl_cleaning"), _step("metrics_clean", "jsonl_clean", method="file_metrics_cleaning")]},
        "analysis": {"description": "look, change nothing", "steps": [extract, _step("analyze_duplicates", "extract", "analyzer", method="duplicate_analysis"), _step("analyze_metrics", "extract", "analyzer", method="metrics_analysis")]},
    }


def coerce(kind: type, value: Any) -> Any:
    """A value, perhaps as text, as the kind that its key has."""
    if isinstance(value, kind) and not (kind is int and isinstance(value, bool)):
        return value
    if kind is bool:
        return value.strip().lower() in ("true", "yes", "on", "1") if isinstance(value, str) else bool(value)
    if kind is list:
        return [x.strip() for x in value.split(",") if x.strip()] if isinstance(value, str) else list(value)
    if kind is dict:
        return json.loads(value)
    return kind(value)


def pipeline_errors(pipeline: dict) -> list[str]:
    """What keeps a pipeline from running: names, kinds, unknown or circular dependencies."""
    steps = pipeline.get("steps") or []
    out = [] if steps else ["no steps"]
    names = [s.get("name") for s in steps]
    out += [f"name used twice: {n}" for n in sorted({n for n in names if names.count(n) > 1}, key=str)]
    for s in steps:
        kind, method = s.get("type"), (s.get("config") or {}).get("method", "")
        if not s.get("name"):
            out.append("a step without a name")
        if kind not in STEP_METHODS:
            out.append(f"{s.get('name')}: unknown type {kind}")
        elif kind != "extractor" and method not in STEP_METHODS[kind]:
            out.append(f"{s.get('name')}: unknown method {method}")
        out += [f"{s.get('name')}: depends on unknown {d}" for d in s.get("depends_on") or [] if d not in names]
    if not out and len(execution_order(steps)) < len(steps):
        out.append("the steps depend on each other in a circle")
    return out


def execution_order(steps: list[dict]) -> list[dict]:
    """Steps after what they depend on, otherwise as given; steps in a circle are left out."""
    done: list[dict] = []
    left = list(steps)
    while ready := next((s for s in left if set(s.get("depends_on") or []) <= {d["name"] for d in done}), None):
        left.remove(ready)
        done.append(ready)
    return done


class Config:
    """Values by section. Unknown keys are carried along. Nothing is written before save()."""

    def __init__(self, values: dict | None = None, path: str | Path | None = None) -> None:
        self.path = Path(path) if path else None
        given = values if values is not None else self._load(self.path) if self.path and self.path.exists() else {}
        self.values = self._filled(given)

    @staticmethod
    def _load(path: Path) -> dict:
        text = path.read_text("utf-8")
        if path.suffix == ".json":
            return json.loads(text)
        if yaml is None:
            raise RuntimeError("YAML files need PyYAML")
        return yaml.safe_load(text) or {}

    @staticmethod
    def _dump(values: dict, path: Path) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(values, ensure_ascii=False, indent=2) if path.suffix == ".json" or yaml is None else yaml.safe_dump(values, allow_unicode=True, sort_keys=False), "utf-8")

    @staticmethod
    def _filled(given: dict) -> dict:
        out = copy.deepcopy(given)
        for section, keys in SECTIONS.items():
            own = out.setdefault(section, {}) or {}
            out[section] = own
            for name, key in keys.items():
                value = os.environ.get(key.env, own.get(name)) if key.env else own.get(name)
                own[name] = copy.deepcopy(key.default) if value is None else coerce(key.kind, value)
                if name == "thresholds":
                    own[name] = {**key.default, **own[name]}
        out["pipeline"]["pipelines"] = standard_pipelines() | (out["pipeline"]["pipelines"] or {})
        return out

    def errors(self) -> list[str]:
        out = []
        for section, keys in SECTIONS.items():
            for name, key in keys.items():
                value = self.values[section][name]
                if not isinstance(value, key.kind) or key.check and not key.check(value):
                    out.append(f"{section}.{name}: not valid: {value!r}")
        for name, p in self.values["pipeline"]["pipelines"].items():
            out += [f"pipeline {name}: {e}" for e in pipeline_errors(p)]
        return out

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, path: str, value: Any) -> None:
        """Coerces and checks before it changes anything."""
        *parents, name = path.split(".")
        key = SECTIONS.get(parents[0] if len(parents) == 1 else "", {}).get(name)
        if key:
            value = coerce(key.kind, value)
            if key.check and not key.check(value):
                raise ValueError(f"{path}: not valid: {value!r}")
        at = self.values
        for part in parents:
            at = at.setdefault(part, {})
        at[name] = value

    def update(self, values: dict) -> None:
        for section, own in values.items():
            for name, value in own.items():
                self.set(f"{section}.{name}", value)

    def reset(self, section: str | None = None) -> None:
        fresh = self._filled({})
        self.values = fresh if section is None else self.values | {section: fresh[section]}

    def save(self, path: str | Path | None = None) -> None:
        target = Path(path) if path else self.path
        if target is None:
            raise ValueError("no file to write to")
        self._dump(self.values, target)

    export = save

    @classmethod
    def template(cls) -> Config:
        return cls({})

    @classmethod
    def check_file(cls, path: str | Path) -> list[str]:
        try:
            return cls(path=path).errors()
        except (ValueError, TypeError, OSError) as e:
            return [str(e)]

    def info(self) -> dict[str, dict[str, str]]:
        return {s: {n: f"{k.kind.__name__}, {k.about}" + (f", from ${k.env}" if k.env else "") for n, k in keys.items()} for s, keys in SECTIONS.items()}

    def pipeline(self, name: str | None = None) -> dict:
        name = name or self.get("pipeline.default_pipeline")
        found = self.get("pipeline.pipelines", {}).get(name)
        if found is None:
            raise ValueError(f"no pipeline {name}")
        return found

    def add_pipeline(self, name: str, pipeline: dict, replace: bool = False) -> None:
        if name in self.values["pipeline"]["pipelines"] and not replace:
            raise ValueError(f"{name} exists already")
        if wrong := pipeline_errors(pipeline):
            raise ValueError("; ".join(wrong))
        self.values["pipeline"]["pipelines"][name] = pipeline

    def remove_pipeline(self, name: str) -> None:
        del self.values["pipeline"]["pipelines"][name]
