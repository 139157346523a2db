"""Command line: ``python -m twinscan [paths] [options]``."""

from __future__ import annotations

import argparse
import re
import sys

from twinscan import __version__
from twinscan.options import EXTENSIONS, MODES, Options


def _number(text: str) -> float:
    if not re.fullmatch(r"\d+(?:\.\d+)?|\.\d+", text):
        raise argparse.ArgumentTypeError(f"not a plain decimal number: {text!r}")
    return float(text)


def _count(text: str) -> int:
    if not re.fullmatch(r"\d+", text):
        raise argparse.ArgumentTypeError(f"not a plain whole number: {text!r}")
    return int(text)


def _list(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("twinscan", description="Find near-duplicate functions, types, classes and parts of functions.")
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--cwd", default=".")
    p.add_argument("--modes", type=_list, default=MODES)
    p.add_argument("--threshold", type=_number, default=0.8)
    p.add_argument("--min-lines", type=_count, default=3)
    p.add_argument("--min-tokens", type=_count)
    p.add_argument("--no-size-penalty", dest="size_penalty", action="store_false")
    p.add_argument("--same-file-only", action="store_true")
    p.add_argument("--cross-file-only", action="store_true")
    p.add_argument("--extensions", type=_list, default=EXTENSIONS)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--types-only", choices=("all", "interface", "type"), default="all")
    p.add_argument("--allow-cross-kind", action="store_true", help="the default; kept for old scripts")
    p.add_argument("--no-allow-cross-kind", dest="cross_kind", action="store_false")
    p.add_argument("--type-literals", action="store_true")
    p.add_argument("--overlap-min-window", type=_count, default=8)
    p.add_argument("--overlap-max-window", type=_count, default=30)
    p.add_argument("--overlap-size-tolerance", type=_number, default=0.2)
    p.add_argument("--format", choices=("pretty", "json"), default="pretty")
    p.add_argument("--output")
    p.add_argument("--pairs", help="write all pairs as a Parquet table to this folder and report their number only; for results of any size")
    p.add_argument("--fail-on-warnings", action="store_true")
    p.add_argument("--fail-on-duplicates", action="store_true")
    return p


def options_of(a: argparse.Namespace) -> Options:
    return Options(
        modes=a.modes, threshold=a.threshold, min_lines=a.min_lines, min_tokens=a.min_tokens, size_penalty=a.size_penalty, same_file_only=a.same_file_only,
        cross_file_only=a.cross_file_only, extensions=a.extensions, exclude=tuple(a.exclude), types_only=a.types_only, allow_cross_kind=a.cross_kind,
        type_literals=a.type_literals, overlap_min_window=a.overlap_min_window, overlap_max_window=a.overlap_max_window, overlap_size_tolerance=a.overlap_size_tolerance,
    )


def exit_code(report: dict, fail_on_warnings: bool, fail_on_duplicates: bool) -> int:
    warned = bool(report["warnings"]) and (fail_on_warnings or report["stats"]["fileCount"] == 0)
    return int(warned or fail_on_duplicates and report["stats"]["pairCount"] > 0)


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    try:
        options = options_of(a)
        from twinscan.report import analyze_project, as_json, as_text, write_project, write_text

        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("twinscan").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        if a.pairs:
            report = write_project(spark, a.paths, a.pairs, a.cwd, options)
            print(f"Files analyzed: {report['stats']['fileCount']}\nSimilar pairs: {report['stats']['pairCount']}")
            return exit_code(report, a.fail_on_warnings, a.fail_on_duplicates)
        report = analyze_project(spark, a.paths, a.cwd, options)
        text = as_json(report) + "\n" if a.format == "json" else as_text(report, options.modes)
        if a.output:
            write_text(text, a.output)
        else:
            sys.stdout.write(text)
        for w in report["warnings"]:
            print(f"{w['filePath']}: {w['message']}" if w["filePath"] else w["message"], file=sys.stderr)
        return exit_code(report, a.fail_on_warnings, a.fail_on_duplicates)
    except Exception as e:  # noqa: BLE001 - a command ends with a message, not a trace
        print(f"error: {e}", file=sys.stderr)
        return 1
