"""Reports of an analysis. A report is for people: it is collected; tables of any size go to ``write_pairs``."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import SparkSession

from twinscan.engine import Analysis, analyze
from twinscan.options import Options
from twinscan.sources.files import discover, read_files, shown_path


def _location(loc: dict) -> dict:
    return {"filePath": loc["file_path"], "startLine": loc["start_line"], "endLine": loc["end_line"], "symbolName": loc["symbol_name"], "kind": loc["kind"]}


# Key names of the JSON report.
SCORE_KEY = "similarity"
_DETAILS = {"impact": "impact", "structural_score": "structuralSimilarity", "naming_score": "namingSimilarity", "node_count": "nodeCount", "node_type": "nodeType"}


def build(result: Analysis, files: list[str], skipped: list[str] = (), warnings: list[tuple[str | None, str]] = (), started: float | None = None) -> dict:  # type: ignore[assignment]
    """The complete report as plain data."""
    pairs = []
    for r in result.ranked().collect():
        row = r.asDict(True)
        pairs.append(
            {"mode": row["mode"], SCORE_KEY: row["score"], "left": _location(row["left_loc"]), "right": _location(row["right_loc"]), "details": {_DETAILS[k]: v for k, v in row["details"].items() if v is not None}}
        )
    failed = {r["file_path"]: r["error"] for r in result.skipped.collect()}
    # Only the function mode reports files that do not parse as skipped; otherwise they are a warning.
    counted = failed if "functions" in result.options.modes else {}
    notes = [{"filePath": p, "message": m} for p, m in [*warnings, *sorted(failed.items())]]
    analyzed = [f for f in files if f not in counted]
    return {
        "analyzedFiles": analyzed,
        "skippedFiles": sorted([*skipped, *counted]),
        "warnings": notes,
        "results": pairs,
        "byMode": {m: [p for p in pairs if p["mode"] == m] for m in ("functions", "types", "classes", "overlap")},
        "stats": {"fileCount": len(analyzed), "pairCount": len(pairs), "elapsedMs": int((time.time() - started) * 1000) if started else 0},
    }


def analyze_project(spark: SparkSession, paths: list[str], cwd: str = ".", options: Options | None = None) -> dict:
    """Discover, read and analyze a project; the report."""
    started, options = time.time(), options or Options()
    found = discover(paths, cwd, options.extensions, options.exclude)
    result = analyze(read_files(spark, found, cwd), options)
    read = {r["file_path"] for r in result.files.collect()}  # the report names every file
    shown = [shown_path(f, cwd) for f in found.files]
    found.warnings += [(f, "failed to read: the file is gone") for f, s in zip(found.files, shown) if s not in read]
    shown = [s for s in shown if s in read]
    return build(result, shown, [shown_path(f, cwd) for f in found.skipped], [(shown_path(p, cwd), m) for p, m in found.warnings], started)


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def as_text(report: dict, modes: tuple[str, ...]) -> str:
    """Counts, one table for every mode asked for, and the warnings."""
    stats = report["stats"]
    out = [f"Files analyzed: {stats['fileCount']}", f"Similar pairs: {stats['pairCount']}", f"Elapsed: {stats['elapsedMs']} ms"]
    place = lambda x: f"{x['filePath']}:{x['startLine']}-{x['endLine']} {x['symbolName']}"
    for mode in modes:
        rows = [("score", "left", "right"), *((f"{p[SCORE_KEY]:.3f}", place(p["left"]), place(p["right"])) for p in report["byMode"][mode])]
        out += ["", f"{mode} ({len(rows) - 1})"]
        if len(rows) > 1:
            widths = [max(len(r[i]) for r in rows) for i in range(3)]
            out += ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows]
    if report["warnings"]:
        out += ["", "Warnings", *(f"{w['filePath']}: {w['message']}" if w["filePath"] else w["message"] for w in report["warnings"])]
    return "\n".join(out) + "\n"


def write_text(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, "utf-8")


def write_pairs(result: Analysis, path: str, format: str = "parquet") -> None:
    """All pairs as a table, partitioned by mode, without passing the driver."""
    result.pairs.drop("l", "r").write.partitionBy("mode").format(format).save(path)


def write_project(spark: SparkSession, paths: list[str], path: str, cwd: str = ".", options: Options | None = None) -> dict:
    """Discover, read and analyze a project and write its pairs to ``path``; warnings and counts only."""
    options = options or Options()
    found = discover(paths, cwd, options.extensions, options.exclude)
    result = analyze(read_files(spark, found, cwd), options)
    write_pairs(result, path)
    pairs = spark.read.parquet(path).count()
    files = result.counts().first()["file_count"]
    return {"warnings": [{"filePath": p, "message": m} for p, m in found.warnings], "stats": {"fileCount": files, "pairCount": pairs}}
