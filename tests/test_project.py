"""Discovery, reports and the command line on a temporary project."""

import json

import pytest

from tests.test_modes import FETCH, LOAD, TWINS, TYPES
from twinscan.cli import exit_code, main, options_of, parser
from twinscan.report import analyze_project, as_text
from twinscan.sources.files import discover, glob_regex, read_files, shown_path


@pytest.fixture
def project(tmp_path):
    files = {
        "src/a.ts": "﻿" + LOAD + TYPES, "src/b b+c.tsx": FETCH + TWINS, "src/c.js": "x", "node_modules/m/a.ts": LOAD, "dist/a.ts": LOAD,
        ".gitignore": "*.gen.ts\n!keep.gen.ts\n/root.ts\n# comment\nlogs/\n", "src/x.gen.ts": LOAD, "src/keep.gen.ts": "", "root.ts": LOAD, "src/root.ts": "",
        "src/logs/l.ts": LOAD, "src/deep/.gitignore": "hidden.ts\n", "src/deep/hidden.ts": LOAD, "src/deep/shown.ts": "", "src/.dot.ts": LOAD,
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, "utf-8")
    return tmp_path


def shown(found, cwd):
    return [shown_path(f, cwd) for f in found.files]


def test_discovery_and_ignore_rules(project):
    assert shown(discover(["."], project), project) == ["src/a.ts", "src/b b+c.tsx", "src/deep/shown.ts", "src/keep.gen.ts", "src/root.ts"]
    assert shown(discover(["src"], project, ("js",)), project) == ["src/c.js"]
    assert shown(discover(["."], project, exclude=("src/deep/**", "b*")), project) == ["src/a.ts", "src/keep.gen.ts", "src/root.ts"]
    found = discover(["src/c.js", "src/a.ts", "src/a.ts", "src/x.gen.ts", "nowhere"], project)
    assert shown(found, project) == ["src/a.ts"] and [shown_path(s, project) for s in found.skipped] == ["src/c.js"]
    assert found.warnings == [(str(project / "nowhere"), "path does not exist")]


def test_targets_outside_the_project_use_their_own_rules(project, tmp_path_factory):
    elsewhere = tmp_path_factory.mktemp("cwd")
    (project / ".git").mkdir()
    found = discover([str(project / "src")], elsewhere)
    assert [f.rsplit("/", 1)[-1] for f in found.files] == ["a.ts", "b b+c.tsx", "shown.ts", "keep.gen.ts", "root.ts"]


@pytest.mark.parametrize("pattern,path,hit", [("*.ts", "a/b.ts", True), ("/a", "b/a", False), ("a/", "a/b", True), ("a/**/b", "a/b", True), ("a?c", "abc", True), ("[ab].ts", "c.ts", False), ("a/*", "a/b/c", True), ("**/x", "q/r/x", True)])
def test_glob(pattern, path, hit):
    assert bool(glob_regex(pattern).match(path)) is hit


def test_contents_are_read_as_utf8(spark, project):
    rows = {r["file_path"]: r["content"] for r in read_files(spark, discover(["src"], project), project).collect()}
    assert rows["src/a.ts"] == LOAD + TYPES and rows["src/b b+c.tsx"] == FETCH + TWINS and rows["src/root.ts"] == ""


def test_report_and_command(spark, project, capsys):
    out = project / "out" / "report.json"
    assert main([".", "--cwd", str(project), "--modes", "functions,types", "--format", "json", "--output", str(out), "--fail-on-duplicates"], spark) == 1
    report = json.loads(out.read_text())
    assert report["stats"]["pairCount"] == 2 and {p["mode"] for p in report["results"]} == {"functions", "types"}
    pair = report["byMode"]["functions"][0]
    assert pair["left"]["filePath"] == "src/a.ts" and set(pair["details"]) == {"impact"} and pair["left"]["kind"] == "function" and pair["right"]["kind"] == "arrow"
    text = as_text(report, ("functions", "types", "classes"))
    assert "functions (1)" in text and "classes (0)" in text and "src/a.ts:1-13 loadAccount" in text
    (project / "src/bad.ts").write_text("function (")
    report = analyze_project(spark, ["src", "nowhere"], str(project), options_of(parser().parse_args(["--modes", "functions"])))
    assert report["skippedFiles"] == ["src/bad.ts"] and "src/bad.ts" not in report["analyzedFiles"] and len(report["warnings"]) == 2
    assert main(["nowhere", "--cwd", str(project), "--modes", "types"], spark) == 1
    assert "nowhere: path does not exist" in capsys.readouterr().err


def test_strict_numbers_and_exit_codes(capsys):
    for bad in (["--threshold", "0x1"], ["--threshold", "1e-1"], ["--min-lines", "2.5"], ["--min-lines", ""], ["--format", "xml"]):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)
    assert main(["--threshold", "3"]) == 1 and main(["--same-file-only", "--cross-file-only"]) == 1
    base = {"warnings": [], "stats": {"fileCount": 1, "pairCount": 1}}
    assert exit_code(base, True, False) == 0 and exit_code(base, False, True) == 1
    warned = {"warnings": [1], "stats": {"fileCount": 1, "pairCount": 0}}
    assert exit_code(warned, False, False) == 0 and exit_code(warned, True, False) == 1 and exit_code(warned | {"stats": {"fileCount": 0, "pairCount": 0}}, False, False) == 1
