"""Reports of an analysis: JSON, CSV, HTML and Markdown, and a tidy table for Spark sinks."""

from __future__ import annotations

import csv
import html
import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SECTIONS: list[tuple[str, str, list[tuple[str, str]]]] = [
    ("Overall", "overall", [("total_files", "Files"), ("total_lines", "Lines"), ("total_size", "Bytes"), ("total_issues", "Issues"), ("total_complexity", "Complexity")]),
    ("Quality", "metrics", [("avg_quality_score", "Mean quality score")]),
    ("Complexity", "metrics", [("avg_complexity", "Mean complexity"), ("max_complexity", "Largest complexity")]),
    ("Maintainability", "metrics", [("avg_maintainability_score", "Mean score"), ("maintainable_files", "Maintainable files"), ("difficult_to_maintain_files", "Files hard to maintain")]),
    ("Readability", "metrics", [("avg_readability_score", "Mean score"), ("highly_readable_files", "Readable files"), ("difficult_to_read_files", "Files hard to read")]),
    ("Tests", "test_coverage", [("test_files", "Test files"), ("source_files", "Source files"), ("test_ratio", "Tests per source file"), ("test_coverage_estimate", "Coverage, estimated")]),
]
KINDS = ("json", "csv", "html", "markdown")
ADVICE = ["Split files that many rules complain about.", "Bring down the most complex functions first.", "Write tests where there are fewest.", "Keep lines short and names plain."]


def tidy(analysis: dict) -> list[tuple[str, str, str]]:
    """(section, name, value) of every figure, languages after the overall figures."""
    rows = []
    for title, key, names in SECTIONS:
        rows += [(title, label, str((analysis.get(key) or {}).get(name) or 0)) for name, label in names]
        if key == "overall":
            rows += [("Language", k, str(v)) for k, v, _ in shares(analysis)]
    return rows


def tidy_table(spark: SparkSession, analysis: dict) -> DataFrame:
    return spark.createDataFrame(tidy(analysis), "section string, name string, value string")


def shares(analysis: dict) -> list[tuple[str, int, float]]:
    """(language, files, percent), most files first."""
    counts = (analysis.get("overall") or {}).get("language_distribution") or {}
    total = sum(counts.values())
    return [(k, v, 100 * v / total if total else 0.0) for k, v in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]


def to_json(analysis: dict) -> str:
    return json.dumps(analysis, ensure_ascii=False, indent=2, default=str)


def to_markdown(analysis: dict) -> str:
    out = ["# Analysis report", ""]
    for title, key, names in SECTIONS:
        out += [f"## {title}", "", *[f"- **{label}**: {_shown((analysis.get(key) or {}).get(name))}" for name, label in names], ""]
        if key == "overall":
            out += ["## Languages", "", *[f"- **{k}**: {v} ({p:.1f}%)" for k, v, p in shares(analysis)], ""]
    return "\n".join([*out, "## Advice", "", *[f"{i}. {a}" for i, a in enumerate(ADVICE, 1)], ""])


def _shown(x) -> str:
    return f"{x:,.2f}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) else str(x or 0)


def to_html(analysis: dict) -> str:
    card = lambda label, value: f"<div class='card'><b>{html.escape(value)}</b><span>{html.escape(label)}</span></div>"
    parts = []
    for title, key, names in SECTIONS:
        parts.append(f"<section><h2>{title}</h2>" + "".join(card(label, _shown((analysis.get(key) or {}).get(name))) for name, label in names) + "</section>")
        if key == "overall":
            parts.append("<section><h2>Languages</h2><ul>" + "".join(f"<li>{html.escape(k)}: {v} ({p:.1f}%)</li>" for k, v, p in shares(analysis)) + "</ul></section>")
    style = ".card{display:inline-block;margin:8px;padding:12px;border:1px solid #ccc}.card b,.card span{display:block}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Analysis report</title><style>{style}</style></head><body><h1>Analysis report</h1>{''.join(parts)}</body></html>"


def write(analysis: dict, kind: str, folder: str | Path, stamp: str | None = None) -> list[str]:
    """Write one kind of report, or all for `comprehensive`; returns the paths."""
    kinds = list(KINDS) if kind == "comprehensive" else [kind]
    folder, stamp, out = Path(folder), stamp or f"{datetime.now():%Y%m%dT%H%M%S}", []
    folder.mkdir(parents=True, exist_ok=True)
    for k in kinds:
        path = folder / f"analysis_report_{stamp}.{'md' if k == 'markdown' else k}"
        if k == "csv":
            with path.open("w", newline="", encoding="utf-8") as f:
                csv.writer(f).writerows([("section", "name", "value"), *tidy(analysis)])
        else:
            path.write_text({"json": to_json, "html": to_html, "markdown": to_markdown}[k](analysis), encoding="utf-8")
        out.append(str(path))
    return out
